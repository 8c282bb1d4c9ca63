"""Ids against the tiktoken library, texts against Python's own decoder."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyweir.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "", " ", "a", "It's 12 o'clock, isn't it?  Well\n\n  then\t", "Ünïcödé čеловек 漢字かな한국어 ٣٤ 👩‍👩‍👧", "a" * 5000, " " * 300, "\r\n" * 50, "-" * 200, "the the the", "<|endoftext|>", "\u0000\u0001",
    "no spaces" * 50, "é" * 100, "1234567890" * 9, "x y z", "🏳️‍🌈" * 20, "�﻿",
]


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return bpe.Vocabulary(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def random_texts(rng, ranks, n):
    tokens = list(ranks)
    for k in range(n):
        if k % 3:
            yield b"".join(rng.choices(tokens, k=rng.randint(1, 12))).decode("utf-8", "ignore")
        else:
            yield "".join(rng.choices("aeinst \n'1é漢👩", k=rng.randint(1, 60)))


def test_ids_are_those_of_the_library(ranks, vocabulary, library):
    encoder = bpe.Encoder(vocabulary, public_tokenizers.PATTERN)
    for text in [*TEXTS, *random_texts(random.Random(1), ranks, 3000)]:
        assert encoder.encode(text) == pack(library.encode_ordinary(text)), text


def test_few_arrows_and_any_chunks_give_the_same(ranks, vocabulary, library):
    rng, small = random.Random(2), bpe.Transducer(vocabulary, most_arrows=40)
    for text in random_texts(rng, ranks, 400):
        data = text.encode()
        if not data:
            continue
        cuts = sorted(rng.choices(range(len(data) + 1), k=3))
        chunks = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        assert small.encode(data) == list(small.tokens(chunks)) == library._core_bpe.encode_single_piece(data)
        assert len(small.arrows) <= 40


def test_tokens_leave_before_the_end(vocabulary):
    transducer, seen = bpe.Transducer(vocabulary), []

    def chunks():
        for k in range(1000):
            seen.append((k, len(out)))
            yield b"wordswithoutspace"

    out = []
    for token in transducer.tokens(chunks()):
        out.append(token)
    assert all(n >= 3 * (k - 5) for k, n in seen)  # every word has three tokens or more, and only the last few words wait


def test_long_texts_go_in_parts(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(bpe, "MATCHES", 7)
    text = "Many words, of which some thousand make a text. " * 30
    assert bpe.Encoder(vocabulary, public_tokenizers.PATTERN).encode(text) == pack(library.encode_ordinary(text))


def test_whole_tokens_that_no_merge_makes():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bcd": 258}  # nothing makes bcd of b and cd, nor of bc and d
    vocabulary = bpe.Vocabulary(ranks)
    transducer = bpe.Transducer(vocabulary)
    assert transducer.encode(b"bcd") == [258] and transducer.encode(b"xbcd") == [*b"xbcd"] and transducer.encode(b"abcd") == [257, ord("d")]
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})


@pytest.mark.parametrize("seed", range(5))
def test_small_vocabularies_against_merging(seed):
    rng = random.Random(seed)
    ranks, parts = {bytes([b]): b for b in range(256)}, [b"a", b"b", b"c"]
    for n in range(25):
        token = rng.choice(parts) + rng.choice(parts)
        if token not in ranks:
            ranks[token] = 256 + n
            parts.append(token)
    try:
        transducer = bpe.Transducer(bpe.Vocabulary(ranks))
    except ValueError:
        pytest.skip("not made by merges")
    library = tiktoken.Encoding("small", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
    for _ in range(2000):
        data = bytes(rng.choices(b"abc", k=rng.randint(1, 30)))
        assert transducer.encode(data) == library._core_bpe.encode_single_piece(data), data


def test_any_tokens_decode_as_python_does(ranks, vocabulary):
    rng, ids = random.Random(3), list(ranks.values())
    odd = [ranks[bytes([b])] for b in (*range(0x78, 0x100), 0x80, 0xBF, 0xE0, 0xED, 0xF0, 0xF4)]
    for k in range(4000):
        chosen = rng.choices(odd if k % 2 else ids, k=rng.randint(0, 12))
        data = b"".join(vocabulary.bytes[i] for i in chosen)
        stream = bpe.TextStream(vocabulary.bytes)
        parts = [stream.add(i) for i in chosen]
        assert "".join(parts) + stream.end() == data.decode("utf-8", "replace"), data


def test_characters_leave_when_they_are_whole(ranks, vocabulary):
    stream = bpe.TextStream(vocabulary.bytes)
    assert [stream.add(ranks[bytes([b])]) for b in "aé漢".encode()] == ["a", "", "é", "", "", "漢"] and stream.end() == ""


def test_query_against_the_library(spark, library, tmp_path):
    texts = [*TEXTS, None, "word " * 100_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1, "again"), (1, "again"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = [(i, len(library.encode_ordinary(t or "")), sha(pack(library.encode_ordinary(t or ""))), sha((t or "").encode())) for i, t in rows]
    got = bpe.op11_bpe_transducer(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_columns_keep_nulls_and_take_empty_tables(spark):
    tokenizer = bpe.Tokenizer(spark, RANKS, public_tokenizers.PATTERN)
    rows = spark.createDataFrame([("a b",), (None,)], "t string")
    got = rows.select(tokenizer.ids(F.col("t")).alias("ids")).select("ids", tokenizer.text(F.col("ids")).alias("back")).collect()
    assert [r.back for r in got] == ["a b", None] and got[1].ids is None
    assert rows.limit(0).select(tokenizer.ids(F.col("t"))).count() == 0
