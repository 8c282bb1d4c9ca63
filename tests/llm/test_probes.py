"""Awkward pages, texts, columns and scripts, one by one."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweir.llm import classifiers, countmin, divergence, fmindex, htmltext, linechunks, setjoin, sketch, warc

LONG = "Some long text here of the article, which goes on for a while."
PAGES = [
    ('<div class="layout has-sidebar"><nav>m</nav><article><h1>T</h1><p>%s</p></article></div>' % LONG, f"T\n{LONG}"),
    ('<body><form><div class="hidden-xs"><h1>T</h1><p>%s</p></div><div class="sidebar">x</div></form></body>' % LONG, f"T\n{LONG}"),
    ('<main><article><h1>T</h1><p>%s</p></article><article class="comment"><p>Me too, and at length.</p></article></main>' % LONG, f"T\n{LONG}"),
    ('<main><h1>T</h1><p>Short.</p><section class="comments"><article class="comment"><p>%s</p></article></section></main>' % LONG, "T\nShort."),
    ('<body><div id=top><a href=1>Home</a> <a href=2>News</a></div><h1>T</h1><div class=text><p>%s<p>With <a href=x>a link</a> in it.</div></body>' % LONG, f"T\n{LONG}\nWith a link in it."),
    ("<article><p>before</p><![foo[x]]><p>after</p></article>", "before\nafter"),
    ("<nav><a href=1>a</a></nav><footer>f</footer>", ""),
    ("<article>short</article><div class=ad>%s %s</div>" % (LONG, LONG), "short"),
    ("<article><p>%s</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></article>" % LONG, LONG),
    ("no tags", "no tags"), ("", ""), (None, ""),
]


def test_pages_through_spark(spark):
    rows = [(k, h) for k, (h, _) in enumerate(PAGES)] + [(k, PAGES[0][0]) for k in (100, 100)]
    out = htmltext.extract_main_text(spark.createDataFrame(rows, "page_id int, html string")).collect()
    assert {r.page_id: r.text for r in out} == {**{k: t for k, (_, t) in enumerate(PAGES)}, 100: PAGES[0][1]} and len(out) == len(rows)
    assert htmltext.extract_main_text(spark.createDataFrame([], "page_id int, html string")).count() == 0


def test_deep_pages_take_time_in_proportion():
    took = []
    for n in (5_000, 20_000):
        start = time.time()
        assert htmltext.main_text("<div>" * n + "x" + "</span>" * n) == "x"
        htmltext.main_text("<li><ul>" + "<i>" * n + "<li></li>" * n)
        took.append(time.time() - start)
    assert took[1] < 9 * took[0] + 1


def test_all_code_points_have_a_class():
    of = lambda text: divergence.CLASSES[int(np.argmax(divergence.class_counts(divergence._codes(text))))]
    assert [of(x) for x in ("a", "A", "é", "漢字", "한국", "かな", "7", "٧", "　", "😀", "\U00020000")] == [
        "lower", "upper", *["letter beyond ASCII"] * 4, "digit", "digit", "white space", "other", "letter beyond ASCII"
    ]


def test_rules_through_spark(spark):
    rng = np.random.default_rng(2)
    words = lambda lang, n: " ".join(f"{lang}{k}" for k in rng.integers(0, 60, n))
    rows = [(k, words(lang := "ab"[k % 2], 120), lang) for k in range(60)]
    rows += [(100, words("b", 300), "a"), (101, words("a", 300), None), (102, words("a", 300), "dirty"), (103, "漢" * 400, "a"), (104, None, "a"), (105, "", None), (106, rows[0][1], "a")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    seen = []
    for parts in (1, 7):
        df = docs.repartition(parts)
        refs = divergence.language_references(df)
        out = divergence.apply_quality_rules(df, refs).select("doc_id", "rules.*")
        seen.append({r.doc_id: r for r in out.collect()})
        # the Spark rows are those of the plain function
        assert all(tuple(seen[-1][i])[1:] == pytest.approx(divergence.judge(t, lang, refs), nan_ok=True) for i, t, lang in rows)
    assert seen[0] == seen[1]
    kept = {i: r.kept for i, r in seen[0].items()}
    assert kept[0] and kept[101] and not any(kept[i] for i in (100, 103, 104, 105)) and kept[106] == kept[0]
    assert divergence.language_references(docs.limit(0)) == {} and divergence.apply_quality_rules(docs.limit(0), {}).count() == 0


def test_line_dedup_with_clashing_columns_and_repeats(spark):
    block = "\n".join(f"shared line {k} of the block" for k in range(12))
    rows = [(1, f"a\n{block}"), (1, f"b\n{block}"), (2, f"c\n{block}"), (2, f"c\n{block}"), (None, None), (None, f"n\n{block}"), (3, "x\n" * 5000)]
    names = ["_lines", "_kept", "_ranges", "_lost_id", "_lost_t", "_row", "_id", "_text", "_t", "_n_lines", "_n_removed"]
    docs = spark.createDataFrame(rows, "doc_id int, text string").select("*", *[F.lit(c).alias(c) for c in names])
    out = linechunks.dedup_lines(docs).collect()
    assert len(out) == len(rows) and all(r["_row"] == "_row" and r["_lines"] == "_lines" for r in out)
    lost = {(r.doc_id, r.text[:1]): r["_n_removed"] for r in out if r.text}
    assert lost[None, "n"] == 0 and all(lost[k] > 4 for k in ((1, "a"), (1, "b"), (2, "c")))  # the null id sorts first and keeps them
    assert sum(r["_n_removed"] for r in out if r.doc_id == 2) == 2 * lost[2, "c"]  # repeated rows are one document


def test_frequencies_are_never_too_low(spark):
    rng = np.random.default_rng(1)
    values = np.repeat(rng.integers(0, 2**63, 3000, dtype=np.int64), rng.integers(1, 40, 3000))
    rows = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(5)
    seen = sketch.frequencies(rows, lambda bs: (b.column("v").to_numpy().view(np.uint64) for b in bs), len(values))
    v, n = np.unique(values, return_counts=True)
    got, exact = seen.of(v.view(np.uint64)), np.floor(np.log2(n))
    assert (got >= exact).all() and (got == exact).mean() > 0.8
    seen.close()


def test_jaccard_on_a_hot_group_ids_with_several_texts_and_long_texts(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 900, 120)]
    near = lambda: " ".join(f"z{rng.integers(0, 9999)}" if rng.random() < 0.02 else w for w in base)
    big = " ".join(f"v{k}" for k in rng.integers(0, 50_000, 9000))
    rows = [(k, near()) for k in range(160)] + [(200, big), (201, big + " more"), (202, big[: len(big) // 2])] + [(300 + k, " ".join(f"u{x}" for x in rng.integers(0, 999, 30))) for k in range(40)]
    got = setjoin.jaccard_components(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(setjoin.brute_force(rows))
    twice = [(1, "a b c d e f g h"), (2, "x y z"), (2, "a b c d e f g h"), (3, "x y z"), (None, "x y z"), (7, "q w e r"), (7, "q w e r")]
    got = setjoin.jaccard_components(spark.createDataFrame(twice, "doc_id int, text string").withColumns({"_id": F.lit(1), "_label": F.lit(2)}))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (None, None), (7, 7)}


def test_passages_with_null_and_repeated_ids_and_clashing_columns(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, passage), (1, passage), (2, f"x {passage}"), (None, passage), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({c: F.lit(c) for c in ("_id", "_t", "_lost", "_with")})
    got = sorted((r.doc_id or 0, r.n_removed) for r in countmin.remove_repeated_passages(docs).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 60), (3, 0)]


def test_contamination_columns_against_brute_force(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 30, n))
    items = [(f"i{k}", text(n)) for k, n in enumerate((20, 13, 5, 1, 0))] + [("none", None)]
    rows = [(k, text(80) + " " + (items[k % 4][1] if k % 2 else "")) for k in range(40)] + [(90, None), (91, ""), (92, items[2][1].upper())]
    found = fmindex.find_contamination(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"]), r.bad) for r in found.select("doc_id", "hits.n_words", fmindex.n_hit(F.col("hits")).alias("n_hit"), "hits.items", fmindex.contaminated(F.col("hits")).alias("bad")).collect()}
    for i, t in rows:
        w, hit, ids = fmindex.words(t), set(), set()
        for name, x in items:
            y = fmindex.words(x)
            for k in range(max(1, len(y) - 12) if y else 0):
                p = y[k : k + 13]
                places = [j for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
                ids |= {name} if places else set()
                hit |= {j + m for j in places for m in range(len(p))}
        assert got[i] == (len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)), i
    empty = fmindex.find_contamination(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([], "item_id string, text string"))
    assert empty.where(fmindex.n_hit(F.col("hits")) > 0).count() == 0


def test_warc_of_an_empty_table(spark):
    from tallyweir.llm.common import shared_path

    none, root = spark.createDataFrame([], "page_id long, url string, html string"), shared_path(spark, "test-warc-empty")
    directory = warc.write_index(warc.write_archives(none, root), root)
    assert warc.read_captures(warc.capture_keys(none), directory, root).count() == 0


def test_classifiers_through_spark_on_nulls_repeats_and_long_texts(spark):
    rng = np.random.default_rng(6)
    filler = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 300, n))
    rows = [(k, filler(30) + (" vile brute" if k % 3 == 0 else "")) for k in range(600)] + [(900, None), (901, ""), (902, filler(60_000)), (3, "vile brute again"), (3, "vile brute again")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 > 0)) for k in range(600)] + [(None, 1, 1), (901, None, None)], "doc_id int, toxic int, quality int")
    for fit, bad in ((classifiers.fit_toxicity, 1), (classifiers.fit_quality, 0)):
        model = fit(docs, labels, F.col("_id") % 5 != 1)
        out = docs.select("doc_id", classifiers.score_column(model, F.col("text"), spark).alias("s")).collect()
        assert len(out) == len(rows) and all(0 <= r.s <= 1 for r in out)
        held = [(r.doc_id % 3 == 0) == ((r.s >= 0.7) == bool(bad)) for r in out if r.doc_id < 600 and r.doc_id % 5 == 1]
        assert np.mean(held) > 0.95
        assert len({r.s for r in out if r.doc_id in (900, 901)}) == 1
