"""Promotion, retention, rollback and concurrent promotions; migration of an embedding model."""

import pytest
from pyspark.sql import functions as F

from tallyweir.operators.releases import Conflict, Releases, VectorIndex


def test_releases_are_kept_and_taken_back(spark, tmp_path):
    gold = Releases(spark, str(tmp_path / "gold"))
    with pytest.raises(ValueError):
        gold.rollback()
    for n in range(1, 7):
        assert gold.promote({"summary": spark.range(n), "stg_x": spark.range(1), "int_x": spark.range(1)}, f"note {n}") == n
    assert gold.read("summary").count() == 6
    folders = sorted(p.name.split("-")[0] for p in (tmp_path / "gold").iterdir() if p.name.startswith("release="))
    assert folders == ["release=3", "release=4", "release=5", "release=6"]
    assert sorted(p.name for p in next((tmp_path / "gold").glob("release=6-*")).iterdir()) == ["summary"]
    assert gold.rollback() == 5 and gold.read("summary").count() == 5
    assert gold.rollback() == 4 and gold.read("summary").count() == 4
    # those rolled back count among the three: 6 and 5 and 4 stay, 3 goes
    assert gold.promote({"summary": spark.range(7)}) == 7
    assert {r["release"]: (r["state"], r["retained"]) for r in gold.log()} == {
        1: ("superseded", False), 2: ("superseded", False), 3: ("superseded", False), 4: ("superseded", True), 5: ("rolled_back", True), 6: ("rolled_back", True), 7: ("active", True),
    }
    assert gold.rollback() == 4
    with pytest.raises(ValueError):
        gold.rollback()
    assert {(r.release, r.n_rows) for r in gold.counts().collect()} == {(n, n) for n in range(1, 8)}


def test_nothing_to_promote_and_two_at_once(spark, tmp_path):
    gold, other = Releases(spark, str(tmp_path / "gold")), Releases(spark, str(tmp_path / "gold"))
    for tables in ({}, {"stg_a": spark.range(1)}):
        with pytest.raises(ValueError):
            gold.promote(tables)
    gold.promote({"a": spark.range(1)})
    read = gold.pointer.read

    def read_then_other_promotes():
        seen = read()
        gold.pointer.read = read
        other.promote({"a": spark.range(2)})
        return seen

    gold.pointer.read = read_then_other_promotes
    with pytest.raises(Conflict):
        gold.promote({"a": spark.range(3)})
    assert gold.read("a").count() == 2 and len(list((tmp_path / "gold").glob("release=*"))) == 2


def test_a_model_is_replaced_only_by_one_that_finds_as_much(spark, tmp_path):
    words = {"x": "river water boat fish lake", "y": "engine wheel road brake fuel"}
    texts = [(k, " ".join(words[lab].split()[(k // 2 + j) % 5] for j in range(3)), lab) for k in range(20) for lab in ["xy"[k % 2]]]
    docs = spark.createDataFrame(texts, "doc_id long, text string, label string")
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(docs.select("doc_id", "text"), "hash-64", 64)
    index.build(docs.select("doc_id", "text"), "hash-1", 1)
    with pytest.raises(ValueError):
        index.build(docs, "hash-64", 32)
    assert index.active() == {"model": "hash-64", "dims": 64} and index.models() == {"hash-64": 64, "hash-1": 1}
    more = spark.createDataFrame([(100, "river boat lake"), (0, "fish lake boat")], "doc_id long, text string")
    for _ in range(2):
        index.write(more, 1)
    assert index.vectors("hash-64").count() == index.vectors("hash-1").count() == 21
    queries, labels = docs.select("doc_id", "text"), docs.select("doc_id", "label")
    with pytest.raises(ValueError):
        index.cut_over(queries, labels, "hash-1", 3)
    assert index.active()["model"] == "hash-64"
    index.build(docs.select("doc_id", "text"), "hash-128", 128)
    scores = index.cut_over(queries, labels, "hash-128", 3)
    assert index.active() == {"model": "hash-128", "dims": 128} and scores["hash-128"] >= scores["hash-64"] > 0.9
    with pytest.raises(ValueError):
        index.retire("hash-128")
    index.retire("hash-1")
    assert set(index.models()) == {"hash-64", "hash-128"}
    assert index.search(queries.where(F.col("doc_id") == 2), 2).count() >= 2
