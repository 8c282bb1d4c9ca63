"""Uneven keys: 80 % of all events on one user."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyweir.operators import analyses as an
from tallyweir.operators import joins


@pytest.fixture(scope="module")
def skewed(spark):
    events = [(None if k % 97 == 0 else "hot" if k % 5 else f"u{k % 700}", k, k % 3) for k in range(5000)]
    users = [("hot", "s1", "de")] + [(f"u{k}", f"s{k % 4}", "fr") for k in range(0, 900)] + [("u5", "again", "it")]
    return events, users, spark.createDataFrame(events, "user_id string, event_id long, page int"), spark.createDataFrame(users, "user_id string, segment string, country string")


def _joined(events, users, how):
    by = {}
    for u in users:
        by.setdefault(u[0], []).append(u[1:])
    return sorted(((*e, *u) for e in events for u in by.get(e[0], [(None, None)] if how == "left" else []) if e[0] is not None or how == "left"), key=str)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_only_hot_keys_are_spread(spark, skewed, how):
    events, users, e, u = skewed
    assert joins.hot_keys(e, "user_id") == ["hot"]
    out = joins.hot_salted_join(e, u, "user_id", 10, how)
    assert out.columns == ["user_id", "event_id", "page", "segment", "country"]
    assert sorted(map(tuple, out.collect()), key=str) == _joined(events, users, how)
    # what goes to the join of the users: each once, the hot one ten times
    spread = joins.spread(u, "user_id", ["hot"], 10)
    assert spread.count() == len(users) + 9 and spread.where("user_id <> 'hot' and _salt <> 0").count() == 0
    parts = joins.salted(e, "user_id", ["hot"], 10).where("user_id = 'hot'").groupBy("_salt").count().collect()
    assert len(parts) == 10 and max(r["count"] for r in parts) < 2 * min(r["count"] for r in parts)
    assert joins.salted(e, "user_id", ["hot"], 10).where("coalesce(user_id, '') <> 'hot' and _salt <> 0").count() == 0


def test_even_keys_are_joined_as_they_are(spark, skewed):
    even = spark.range(3000).select(F.concat(F.lit("u"), (F.col("id") % 600).cast("string")).alias("user_id"), "id")
    assert joins.hot_keys(even, "user_id") == [] and "_salt" not in joins.hot_salted_join(even, skewed[3], "user_id")._jdf.queryExecution().optimizedPlan().toString()
    assert joins.hot_keys(even.limit(0), "user_id") == [] and joins.hot_salted_join(even.limit(0), skewed[3], "user_id").count() == 0


def test_a_side_is_broadcast_only_while_it_is_small(spark, skewed, monkeypatch):
    _, users, e, u = skewed
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert joins.small(u) and not joins.small(u, most_rows=len(users) - 1) and not joins.small(u, most_bytes=1000)
    assert "broadcast" in plan(an.enrich(e, u, "user_id"))
    monkeypatch.setattr(an, "small", lambda rows: False)
    out = an.enrich(e, u, "user_id")
    assert "strategy=broadcast" not in plan(out) and "_salt" in plan(out) and out.count() == len(_joined(skewed[0], users, "left"))


def test_rows_of_a_join_are_counted_before_it(spark, skewed):
    events, users, e, u = skewed
    got = {(r.segment, r.page): r.events for r in joins.joined_counts(e, u, "user_id", ["page"], ["segment"]).collect()}
    assert got == dict(Counter((r[3], r[2]) for r in _joined(events, users, "inner")))
