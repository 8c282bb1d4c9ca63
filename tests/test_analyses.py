"""Hand-computed answers on eight impressions."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyweir.operators import analyses as an
from tallyweir.operators import rules

STAGES = [("u1", "i11", 1, "d"), ("u1", "i12", 1, "c"), ("u2", "i21", 2, "e"), ("u2", "i22", 2, "d"), ("u3", "i23", 2, "b"), ("u3", "i31", 3, "f"), ("u1", "i32", 3, "f"), ("u2", "i33", 3, "d")]


@pytest.fixture(scope="module")
def events(spark):
    day = datetime.date(2026, 1, 1)
    rows = [(u, i, p, day, 10, 0, k + 1, s) for u, i, p, last in STAGES for k, s in enumerate("abcdef") if s <= last]
    return spark.createDataFrame(rows, "user_id string, impression_id string, page_type int, date date, hour int, min int, second int, event_type string")


def test_funnel(events):
    rows = an.funnel(events).where("page_type = 2").orderBy("event_type").collect()
    assert [r.impressions for r in rows] == [3, 3, 2, 2, 1]
    assert [r.pct_of_total for r in rows] == [100, 100, 66.67, 66.67, 33.33]
    assert [r.pct_from_previous for r in rows] == [None, 100, 66.67, 100, 50]


def test_summary_and_engagement(events):
    agg = an.impressions_aggregated(events)
    two = an.page_type_summary(agg).where("page_type = 2").first()
    assert (two.impressions, two.users, two.avg_depth, two.max_depth, two.avg_duration, two.reaching_d) == (3, 2, 3.67, 5, 2.67, 2)
    users = {r.user_id: r for r in an.user_engagement(agg).collect()}
    assert (users["u1"].events, users["u1"].top_page, users["u1"].top_page_count) == (13, 1, 2)
    assert (users["u3"].top_page, users["u3"].top_page_count) == (2, 1)
    assert {r.page_type: r.pct_reaching_d for r in an.hourly_traffic(agg).collect()} == {1: 50.0, 2: 66.67, 3: 100.0}


def test_salted_join_keeps_unmatched(events, spark):
    users = spark.createDataFrame([("u1", "x")], "user_id string, segment string")
    out = an.enrich_salted(events, users, "user_id")
    assert out.count() == events.count() and out.where("segment = 'x'").count() == 13


def test_upsert_replays(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = rules.merge_upsert(old, new, ["k"])
    twice = rules.merge_upsert(once, new, ["k"])
    assert sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert rules.delete_where(once, F.col("v") == "a").count() == 2
    for source in (spark.createDataFrame([(None, "x")], "k int, v string"), new.unionByName(new)):
        with pytest.raises(ValueError):
            rules.merge_upsert(old, source, ["k"])
    with pytest.raises(ValueError):
        rules.merge_upsert(old, new, ["missing"])
    with_null = spark.createDataFrame([(None, "n"), (1, "a")], "k int, v string")
    assert rules.merge_upsert(with_null, new, ["k"]).count() == 4  # null keys of the target stay


def test_unknown_strategies_raise(events, spark):
    users = spark.createDataFrame([("u1", "x")], "user_id string, segment string")
    with pytest.raises(ValueError):
        an.enrich(events, users, "user_id", "magic")
    with pytest.raises(ValueError):
        an.enrich_salted(events, users, "user_id", how="right")
    assert an.enrich(events, users, "user_id", "salted").columns[0] == "user_id"
