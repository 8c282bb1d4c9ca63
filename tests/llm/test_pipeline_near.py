"""The pipeline's near duplicates: five-word shingles at 0.8."""

import corpus_pipeline
from tallyweir.llm import setjoin


def test_pairs_between_the_rules_of_op9_and_of_the_stage(spark):
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    changed = lambda w, *at: " ".join("new" if k in at else x for k, x in enumerate(w))
    a, b, c = words("a", 50), words("b", 50), words("c", 300)
    # one of 50 words changed: 41 of 51 five-word shingles in common (0.80), 43 of 51 four-word ones (0.84)
    # two of 50 words changed: 36 of 56 (0.64); one of 300: 0.97
    rows = [(1, changed(a)), (2, changed(a, 25)), (3, changed(b)), (4, changed(b, 15, 35)), (5, changed(c)), (6, changed(c, 150)), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 7]
    assert sorted(d for d, _, c in setjoin.brute_force(rows, 5, 80) if c == d) == [1, 3, 4, 5, 7]
    assert {r.doc_id: r.component_id for r in setjoin.jaccard_components(docs).collect()}[2] == 2  # op9's own rule is as it was
