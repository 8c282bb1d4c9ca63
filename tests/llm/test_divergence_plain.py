"""Rules against plain sums over dictionaries."""

import math
import random
from collections import Counter

import pytest

from tallyweir.llm import countmin, divergence as dv


def kind(c):
    if ord(c) < 128:
        return 0 if c.islower() else 1 if c.isupper() else 3 if c.isdigit() else 4 if c in " \t\n\x0b\x0c\r" else 5 if c in ".,;:!?'\"()-" else 6 if c > " " else 7
    return 2 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in "‘’“”–—…¿¡«»" else 7


def far(p, q):
    total = 0.0
    for k in p.keys() | q.keys():
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(max(total, 0.0))


def shares(n):
    return {k: v / sum(n.values()) for k, v in n.items()}


def base_failed(words):
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(words) < 10 or 100 * len(repeated) > 20 * len(words)


def test_verdicts_and_distances_by_definition(spark):
    rng = random.Random(3)
    stock = {lang: [f"{lang}{rng.choice('aeiouäé')}{rng.choice('lmnrst')}{k}" for k in range(80)] for lang in ("xx", "yy", "zz")}
    text = lambda lang, n: " ".join(rng.choice(stock[lang][: rng.choice([5, 80])]) for _ in range(n)) + rng.choice([".", "!", " 漢", ""])
    rows = [(k, text(lang := rng.choice(["xx", "yy"]), rng.randint(5, 150)), rng.choice([lang, lang, lang, None])) for k in range(120)]
    rows += [(200, text("zz", 300), "zz"), (201, "junk " * 5000, "xx"), (202, "# $ % " * 60, "yy"), (203, None, "xx"), (204, "", None), (205, text("xx", 400), "yy")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(5)
    words_of, chars_of = {}, {}
    for _, t, lang in rows:
        if lang and t:
            words_of.setdefault(lang, Counter()).update(w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in t.split())
            chars_of.setdefault(lang, Counter()).update(map(kind, t))
    references = {}
    for lang, n in words_of.items():
        total = sum(n.values())
        common = {w for w, c in n.items() if c >= total * dv.COMMON}
        references[lang] = common, shares(Counter({**{w: n[w] for w in common}, "": total - sum(n[w] for w in common)})), shares(chars_of[lang])
    assert set(references) == {"xx", "yy", "zz"}  # zz in one document only
    got = {r.doc_id: r for r in dv.apply_quality_rules(docs, dv.language_references(docs)).select("doc_id", "rules.*").collect()}
    for i, t, lang in rows:
        t = t or ""
        words, chars = t.split(), None
        near = [references[lang]] if lang in references else list(references.values())
        cd = wd = None
        if len(t) >= dv.LEAST_CHARS:
            low = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
            chars = shares(Counter(map(kind, t)))
            both = [(far(chars, c), far(shares(Counter(w if w in common else "" for w in low)), w_shares)) for common, w_shares, c in near]
            cd, wd = min(both, key=sum)
            wd = wd if len(words) >= dv.LEAST_WORDS else None
        failed = base_failed(words)
        strays = (cd is not None and cd > dv.CHAR_LIMIT + dv.CHAR_WIDEN / math.sqrt(len(t))) or (wd is not None and wd > dv.WORD_LIMIT + dv.WORD_WIDEN / math.sqrt(len(words)))
        r = got[i]
        assert (r.base_failed, r.kept) == (failed, not failed and not strays), i
        for a, b in ((r.char_distance, cd), (r.word_distance, wd)):
            assert (a is None or math.isnan(a)) if b is None else a == pytest.approx(b, abs=1e-6), i  # a root of sums near 0
    assert not got[205].kept and not got[201].kept


def test_rows_of_one_id_lose_the_same_once(spark):
    passage = " ".join(f"p{k}" for k in range(70))
    docs = spark.createDataFrame([(1, passage)] + [(2, f"x {passage} y")] * 40, "doc_id int, text string")
    lost = countmin.remove_repeated_passages(docs).collect()
    assert sorted((r.doc_id, r.n_removed) for r in lost) == [(1, 0)] + [(2, 70)] * 40
