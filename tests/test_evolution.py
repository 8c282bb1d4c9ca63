"""Field ids, staged changes, releases, layouts."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyweir.operators import evolution as ev
from tallyweir.operators.contracts import Rule
from tallyweir.sources import storage as st


def test_columns_follow_their_ids(spark):
    first = spark.createDataFrame([(1, 10, "old")], "k int, a int, note string")
    second = spark.createDataFrame([("new", 20, 2)], "note string, b long, k int")
    schema = [(2, "b", "bigint"), (1, "k", "int"), (9, "note", "string")]
    out = ev.evolved([(first, {"k": 1, "a": 2, "note": 3}), (second, {"note": 9, "b": 2, "k": 1})], schema)
    assert sorted(map(tuple, out.collect())) == [(10, 1, None), (20, 2, "new")]  # a dropped name does not bring its values back
    with pytest.raises(ValueError):
        ev.evolved([(second, {"b": 2})], [(2, "b", "int")])


def test_staged_change(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rules = [Rule("not_null", "k"), Rule("accepted_values", "v", ("a", "b", "c"))]
    out = ev.publish_staged(target, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"], rules)
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        ev.publish_staged(target, spark.createDataFrame([(2, "z")], "k int, v string"), ["k"], rules)


def _events(spark):
    rows = [(f"t{k % 3}", datetime.datetime(2026, 1 + k % 2, 1 + k % 20), f"c{k}", k) for k in range(60)]
    return spark.createDataFrame(rows, "tenant string, ts timestamp_ntz, conversation string, n int")


def test_clustered_and_second_copies_hold_the_same_rows(spark, tmp_path):
    rows = _events(spark)
    st.write_clustered(rows, str(tmp_path / "a"), "tenant", "ts", "conversation", 2)
    st.write_second_copy(rows, str(tmp_path / "b"), ["conversation", "ts"], 2)
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    assert sorted(map(tuple, a.select(*rows.columns).collect())) == sorted(map(tuple, b.collect())) == sorted(map(tuple, rows.collect()))
    plan = a.where("month = '2026-01' and conversation = 'c4'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "EqualTo(conversation,c4)" in plan
    assert st.partition_stats(a, ("month",)).first().records == 30


def test_two_layouts_are_read_as_one_table(spark, tmp_path):
    rows = _events(spark)
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    rows.where("n < 30").withColumn("month", F.date_format("ts", "yyyyMM")).write.partitionBy("month").parquet(old)
    rows.where("n >= 30").withColumn("day", F.to_date("ts")).write.partitionBy("tenant", "day").parquet(new)
    both = st.read_layouts((spark.read.parquet(old), ("month",)), (spark.read.parquet(new), ("day",)))
    assert sorted(r.n for r in both.where("tenant = 't1'").collect()) == [k for k in range(60) if k % 3 == 1]
    plan = both.where("tenant = 't1'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tenant" in plan and "PushedFilters: [IsNotNull(tenant), EqualTo(tenant,t1)]" in plan
