"""Quantiles by counting against those of a sorted list."""

import random

import numpy as np
import pytest

from tallyweir.operators import analyses as an
from tallyweir.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("bits", [3, 12])
def test_quantiles_are_those_of_sorted_values(spark, bits):
    rng = random.Random(bits)
    groups = {
        "one": [7], "two": [1, 10], "ties": [5] * 50 + [6], "wide": [rng.randrange(-(10**9), 10**9) for _ in range(300)], "nulls": [None, None], "some": [None, 3, 1, 2],
        None: [rng.randrange(50) for _ in range(99)], "far": [-(2**40), 2**40, 0],
    }
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v long").repartition(4)
    ps = {"lowest": 0.0, "median": 0.5, "p95": 0.95, "p99": 0.99, "highest": 1.0}
    got = {r.k: [r[p] for p in ps] for r in exact_quantiles(rows, ["k"], "v", ps, bits).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        seen = [v for v in vs if v is not None]
        assert got[k] == ([pytest.approx(np.quantile(seen, p), rel=1e-12, abs=1e-9) for p in ps.values()] if seen else [None] * len(ps)), k
    assert exact_quantiles(rows.limit(0), ["k"], "v", ps).count() == 0
    whole = exact_quantiles(rows.where("k = 'one'"), [], "v", ps).collect()
    assert [list(r) for r in whole] == [[7.0] * 5]


def test_no_task_keeps_a_list_of_values(spark):
    rows = spark.range(1000).selectExpr("id % 3 as k", "id * 7919 % 1000 as v")
    plan = exact_quantiles(rows, ["k"], "v", {"p": 0.9})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan and "ObjectHashAggregate" not in plan
    with pytest.raises(ValueError):
        exact_quantiles(rows.selectExpr("k", "v / 2 as v"), ["k"], "v", {"p": 0.9})


def test_impressions_are_hashed_and_not_sorted(spark):
    ddl = "user_id string, impression_id string, page_type int, date date, hour int, min int, second int, event_type string"
    events = spark.createDataFrame([("u", "i", 1, None, 3, 5, 6, "a")], ddl).union(spark.sql("select 'u', 'i', 1, date'2026-01-02', 3, m, s, e from values (5, 59, 'a'), (6, 1, 'c'), (59, 0, 'b'), (null, 2, null) as t(m, s, e)"))
    out = an.impressions_aggregated(events)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    row = out.collect()[0]
    assert (str(row.first_ts), str(row.last_ts), row.max_stage, row.distinct_events, row.event_count, row.first_second, row.last_second) == ("2026-01-02 03:05:59", "2026-01-02 03:59:00", "c", 3, 4, 0, 59)
