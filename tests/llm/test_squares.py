"""Runs against a search over every period, for any number of words appended at a time."""

import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tallyweir.llm import squares


def every_run(x, least):
    """By definition: for each period the stretches of equal pairs; of equal stretches the least period."""
    found = {}
    for q in range(1, len(x) // 2 + 1):
        s = 0
        while s + q < len(x):
            e = s
            while e + q < len(x) and x[e] == x[e + q]:
                e += 1
            if e > s and e - s + q >= max(least, 2 * q):
                found.setdefault((s, e + q), q)
            s = max(e, s + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


FAMOUS = [
    "", "a", "a" * 11, "a" * 12, "a" * 300, fibonacci(400), thue_morse(500), "a" * 90 + "b" + "a" * 90 + "b" + "a" * 90, ("a" * 30 + "b") * 9,
    "a" * 50 + "b" + "a" * 50 + "c" + "a" * 50 + "b" + "a" * 50, "ab" * 60 + "ba" * 60, "abcdefghijkl" * 2, "abcdefghijk" * 2, "xabcabcabcabcy",
]


def random_words(rng):
    letters, n = rng.choice([1, 2, 2, 3, 8, 50]), rng.randint(0, 200)
    x = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if x:
            i, p = rng.randrange(len(x)), rng.randint(1, 40)
            x[i:i] = x[i : i + p] * rng.randint(1, 6)
    return "".join(chr(97 + c) for c in x)


@pytest.mark.parametrize("least", [2, 5, 12, 30])
def test_runs_are_those_of_the_definition(least):
    rng = random.Random(least)
    for text in FAMOUS + [random_words(rng) for _ in range(25)]:
        words, expected = [c.encode() for c in text], every_run(text, least)
        for piece in (10**6, 1, rng.choice([3, 17, 64])):
            assert squares.find_runs(words, least, piece) == expected, (text, piece)


def test_runs_are_known_after_every_word():
    import numpy as np

    text, catcher = "xyabcabcabcabcabzzzzzzzzzzzzzzzq", squares.SquareCatcher()
    for n, c in enumerate(text):
        catcher.append(np.array([ord(c)]))
        assert catcher.runs() == every_run(text[: n + 1], squares.LEAST)


@pytest.mark.parametrize("shape", ["one word", "one word but for one", "random", "thue"])
def test_time_grows_with_the_words(shape):
    rng = random.Random(5)
    took = []
    for n in (10_000, 40_000):
        text = {"one word": "a" * n, "one word but for one": "a" * (n // 2) + "b" + "a" * (n // 2), "random": "".join(rng.choice("abcdefgh") for _ in range(n)), "thue": thue_morse(n)}[shape]
        words = [c.encode() for c in text]
        start = time.time()
        squares.find_runs(words)
        took.append(time.time() - start)
    assert took[1] < 9 * took[0] + 1


def loop(doc_id, text):
    words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query_against_the_definition(spark, tmp_path):
    rng = random.Random(8)
    sep = lambda: rng.choice([" ", "\n", "\t ", "\x0b", " \r\n"])
    text = lambda n, v: "".join(f"é{rng.randrange(v)}" + sep() for _ in range(n))
    rows = [(k, rng.choice(["", " "]) + text(rng.randint(0, 90), rng.choice([1, 3, 400]))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, text(40_000, 9)), (1, rows[1][1]), (1, "a " * 30), (None, "b " * 20), (504, "a a " * 12)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("x")).withColumn("_words_of", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = squares.op13_dyadic_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and any(r.n_runs for r in got)

    def expected(doc_id, value):
        words = loop("" if doc_id is None else doc_id, value)
        runs = every_run(words, 12) if len(words) < 1000 else squares.find_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))

    key = lambda t: tuple(str(x) for x in t)
    assert sorted(map(tuple, got), key=key) == sorted((expected(*r) for r in rows), key=key)


def test_operator_keeps_columns_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 9, "n")], "id int, body string, text string").withColumn("collapsed", F.lit("old"))
    row = squares.periodic_runs(docs, "body").collect()[0]
    assert (row.text, row.collapsed, [tuple(r) for r in row.runs]) == ("n", "a b", [(0, 18, 2)])
    assert squares.periodic_runs(docs.limit(0), "body").count() == 0
