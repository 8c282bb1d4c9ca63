"""Corpus operators against brute force, on small and awkward inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweir.llm import classifiers, countmin, divergence, fmindex, htmltext, linechunks, mixing, setjoin, warc

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 70))] for _ in range(5)]
    rows = []
    for k in range(80):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            b[rng.randrange(len(b))] = f"x{rng.randint(0, 5)}"
        rows.append((k, rng.choice([" ", "\n"]).join(b)))
    rows += [(200, ""), (201, None), (202, "A b"), (203, "a B"), (204, " \t ")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_repeated_passages(docs):
    rows, df = docs
    out = countmin.remove_repeated_passages(df, window=6).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
    assert sorted(map(tuple, out.collect())) == sorted(countmin.brute_force(rows, 6))


def test_jaccard_components(docs):
    rows, df = docs
    assert sorted(map(tuple, setjoin.jaccard_components(df).collect())) == sorted(setjoin.brute_force(rows))


def test_fm_index_finds_all_windows():
    rng = random.Random(1)
    for _ in range(60):
        alphabet = "a b c D é".split()[: rng.randint(1, 5)]
        text = lambda n: " ".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))  # noqa: B023, E731
        items, texts = [(str(k), text(20)) for k in range(3)], [text(60) for _ in range(5)] + [None, ""]
        for (n, spans, found), t in zip(fmindex.Phrases(items, 3).hits(texts), texts, strict=True):
            w, hit, ids = fmindex.words(t), set(), set()
            for i, x in items:
                y = fmindex.words(x)
                for k in range(max(1, len(y) - 2) if y else 0):
                    p = y[k : k + 3]
                    for at in range(len(w) - len(p) + 1):
                        if w[at : at + len(p)] == p:
                            hit.update(range(at, at + len(p)))
                            ids.add(i)
            assert (n, sum(b - a for a, b in spans), found) == (len(w), len(hit), sorted(ids))


def test_benchmark_in_blocks_gives_the_same(docs, spark):
    _, df = docs
    bench = spark.createDataFrame([(k, t) for k, t in docs[0][:6]], "item_id long, text string")
    one = fmindex.find_contamination(df, bench).select("doc_id", "hits").collect()
    many = fmindex.find_contamination(df, bench, max_block_words=40).select("doc_id", "hits").collect()
    assert sorted(one) == sorted(many)


def test_lines(spark):
    block = "\n".join(f"shared line {k} of the block" for k in range(30))
    rows = [(1, block, "e"), (2, f"first\n{block}\nlast", "e"), (3, None, "e"), (4, "", "e"), (5, "one\ntwo", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _chunk string")
    out = {r.doc_id: r for r in linechunks.dedup_lines(df).collect()}
    assert out[1]._n_removed == 0 and out[2]._n_removed > 15 and out[2].text.startswith("first") and out[2].text.endswith("last")
    assert out[3].text is None and out[4].text == "" and out[5].text == "one\ntwo" and out[1]._chunk == "e"


def test_mix(spark):
    rng = random.Random(0)
    rows = [(k, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "c", None])) for k in range(2000)] + [(5000, None, "a")]
    out = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA + ", source string")).cache()
    assert out.count() == 2001 and out.where("copies > 3").count() == 0
    for r in out.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 40


def test_warc_round_trip(spark):
    rows = [(1, "http://a.example.com/x", "same"), (2, "http://a.example.com/x", "same"), (3, None, None), (4, "https://b.example.com/?q=ü#f", "é" * 500), (5, "x", ""), (6, "x", "six")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    from tallyweir.llm.common import shared_path

    for biggest in (500_000, 1):
        root = shared_path(spark, "test-warc")
        directory = warc.write_index(warc.write_archives(pages, root), root, block_captures=2)
        out = {r.page_id: r for r in warc.read_captures(warc.capture_keys(pages), directory, root, biggest).collect()}
        assert len(out) == 6 and out["1"].record_type == "revisit" and out["1"].refers_to == "2" and out["3"].refers_to == "5"
        assert out["4"].payload_bytes == 1000 and out["4"].payload_digest == warc.digest32(("é" * 500).encode())


def test_html():
    page = "<title>t</title><nav><a href=/>menu</a></nav><div class='cookie-notice'>ok?</div><article><h1>Head &amp; line</h1><p><b>One<br><p>two\n three</article><section id=comments><p>me too</section><footer>f</footer>"
    assert htmltext.main_text(page) == "Head & line\nOne\ntwo three"
    assert htmltext.main_text(None) == htmltext.main_text("") == ""


def test_rules():
    ref = {"en": ({b"the": 0}, divergence.np.array([0.2, 0.8]), divergence.class_counts(divergence._codes("the cat sat on the mat. ")) / 24)}
    row = divergence.judge("a b c d e\nx\na b c d e\nx", "en", ref)
    assert row[:6] == (12, 12, 0, 2, 12, True)
    assert divergence.judge(None, None, ref)[:7] == (0, 0, 0, 0, 0, True, False)


def test_classifiers_learn_and_take_empty_tables(spark):
    rows = [(k, f"plain words number {k % 7} " + ("awful person" if k % 3 == 0 else "kind person")) for k in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 != 0)) for k in range(300)], "doc_id long, toxic int, quality int")
    for fit, bad in ((classifiers.fit_toxicity, 1), (classifiers.fit_quality, 0)):
        score = fit(docs, labels, F.lit(True)).scorer()
        assert (score("awful person") > 0.5) == (bad == 1) and (score("kind person") > 0.5) == (bad == 0) and 0 <= score(None) <= 1
        assert 0 <= fit(docs, labels.limit(0), F.lit(True)).scorer()("x") <= 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA + ", source string")
    assert countmin.remove_repeated_passages(none).count() == 0
    assert setjoin.jaccard_components(none).count() == 0
    assert linechunks.dedup_lines(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
