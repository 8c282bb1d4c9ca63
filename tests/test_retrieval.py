"""Exact search against plain loops, embeddings, migration."""

import random

import numpy as np
import pytest

from tallyweir.operators import retrieval as rt


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(1)
    rows = [(k, k % 3, [rng.uniform(-1, 1) for _ in range(8)]) for k in range(60)] + [(60, 0, [0.0] * 8), (61, 1, None)]
    rows += [(62, rows[5][1], rows[5][2])]  # a tie with 5
    return rows, spark.createDataFrame(rows, "vec_id long, tenant int, embedding array<float>")


@pytest.mark.parametrize("within", [None, "tenant"])
@pytest.mark.parametrize("block", [4096, 3])
def test_knn(vectors, within, block):
    rows, df = vectors
    k, got = 4, {}
    for r in rt.knn_exact(df, df.where("vec_id % 20 = 0 or vec_id = 5"), k, within=within, block=block).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, _, v in rows if v is not None}
    tenant = {i: t for i, t, _ in rows}
    for q in (0, 5, 20, 40, 60):
        score = {i: float(unit[q] @ unit[i]) for i in unit if within is None or tenant[i] == tenant[q]}
        least = sorted(score.values())[-k] - 1e-6
        assert got[q] == {i for i, s in score.items() if s >= least}


def test_no_queries_and_unknown_metric(vectors):
    assert rt.knn_exact(vectors[1], vectors[1].limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        rt.knn_exact(vectors[1], vectors[1], 3, metric="odd")


def test_embeddings_have_unit_length_and_word_order(spark):
    texts = spark.createDataFrame([(1, "one two three"), (2, "three two one"), (3, "One, TWO three!"), (4, ""), (5, None)], "doc_id long, text string")
    got = {r.doc_id: np.array(r.embedding) for r in rt.dense(rt.hash_embed(texts, "doc_id", "text", 256), "doc_id", 256).collect()}
    assert set(got) == {1, 2, 3} and all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in got.values())
    assert np.allclose(got[1], got[3]) and not np.allclose(got[1], got[2])


def test_migration_fills_what_the_new_model_lacks(spark):
    texts = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    old = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0])], "doc_id long, model string, embedding array<float>")
    both = rt.dual_written(texts, old, "b", 16)
    assert both.count() == 4 and rt.dual_written(texts, both, "b", 16).count() == 4
    assert rt.one_model(both, "b", 16).count() == 2
    with pytest.raises(ValueError):
        rt.one_model(both, "a", 16)


def test_hits_within_kind_and_of_paraphrases(spark):
    ranked = spark.createDataFrame([(1, "table:a", 0.9), (1, "column:a.x", 0.95), (1, "table:b", 0.1), (2, "table:b", 0.8), (2, "table:a", 0.8), (3, "table:a", 0.5)], "query_id int, item string, score double")
    asked = spark.createDataFrame([(1, "table:a", False), (2, "table:b", True), (3, "template:t", True), (4, "table:a", None)], "query_id int, expect string, paraphrase boolean")
    r = rt.hit_report(ranked, asked).first()
    assert (r.n, r.hit_1, r.hit_3, r.mrr, r.kind_hit_1) == (4, 0.0, 0.5, 0.25, 0.25)
    assert (r.para_n, r.para_hit_1, r.para_hit_3, r.para_mrr) == (2, 0.0, 0.5, 0.25)


def test_hybrid_scores_of_pairs_on_one_side(spark):
    dense, sparse = (spark.createDataFrame(rows, "query_id int, vec_id int, score double") for rows in ([(1, 5, 1.0), (1, 6, 0.5)], [(1, 6, 0.2), (2, 7, 1.0)]))
    got = {(r.query_id, r.vec_id): round(r.score, 6) for r in rt.hybrid_scores(dense, sparse, 0.75).collect()}
    assert got == {(1, 5): 0.75, (1, 6): 0.425, (2, 7): 0.25}


def test_a_catalog_is_searched_within_one_model(spark):
    rows = [(1, "table", "a", [1.0, 0.0]), (2, "column", "a", [0.9, 0.1]), (3, "table", "b", [1.0, 0.0]), (4, "table", "a", [0.0, 1.0])]
    entries = spark.createDataFrame(rows, "vec_id int, kind string, model string, embedding array<double>")
    asked = entries.where("vec_id in (1, 3)")
    assert sorted((r.query_id, r.vec_id) for r in rt.catalog_search(entries, asked, "a", 2, ["table"]).collect()) == [(1, 1), (1, 4)]
    assert {r.vec_id for r in rt.catalog_search(entries, asked, "b", 5).collect()} == {3}
