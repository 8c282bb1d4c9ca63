"""Monitors, versions and retrieval on hand-computed rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyweir.operators import monitors as mo
from tallyweir.operators import retrieval as rt
from tallyweir.operators import versions as ve


def test_robust_z_and_its_fallbacks(spark):
    rows = spark.createDataFrame([(10.0, [1.0, 2.0, 3.0]), (5.0, [4.0, 4.0, 4.0, 8.0]), (4.0, [4.0, 4.0]), (5.0, [4.0, 4.0]), (1.0, [])], "x double, h array<double>")
    z = [r[0] for r in rows.select(mo.robust_z(F.col("x"), F.col("h"))).collect()]
    assert z[:2] == [pytest.approx(8 / 1.4826), pytest.approx(1 / 1.4826)] and z[2:] == [0.0, math.inf, None]


def test_mean_deviation_is_scaled_like_the_median_one(spark):
    """17 after (10, 10, 10, 10, 10, 20): no median deviation, mean deviation 10 / 6, so 7 / (1.4826 * 10 / 6) = 2.83: ok."""
    rows = spark.createDataFrame([(17.0, [10.0] * 5 + [20.0]), (1e-12, [0.0, 0.0])], "x double, h array<double>")
    z = rows.select(mo.robust_z(F.col("x"), F.col("h")).alias("z")).withColumn("status", mo.shift_status(F.col("z"))).collect()
    assert z[0].z == pytest.approx(2.8329, abs=1e-4) and z[0].status == "ok" and z[1].z == 0.0


def test_diff(spark):
    a, b = (spark.createDataFrame([(x,) for x in k], "k string") for k in ("ab", "bc"))
    assert {r.k: r.state for r in mo.finding_diff(a, b, "k").collect()} == {"a": "new", "b": "open", "c": "cleared"}


def _one_run_at_a_time(rows):
    """The rule itself: what was sent in the last three runs of the log waits; only runs that sent something are in the log."""
    log, sent = [], []
    for run in sorted({r for r, _, s in rows if s != "ok"}):
        waiting = {x for one in log[-3:] for x in one}
        now = {(k, s) for r, k, s in rows if r == run and s != "ok"} - waiting
        if now:
            log.append(now)
            sent += [(run, k, s) for k, s in now]
    return sorted(sent)


def test_an_alert_that_goes_on_is_sent_again_after_three_runs_that_sent_something(spark):
    beside = [(r, "k", "warn") for r in range(1, 9)] + [(r, f"other{r}", "breach") for r in range(1, 9)]
    alone = [(r, "k", "warn") for r in range(1, 9)] + [(2, "j", "ok")]
    status = [(1, "k", "warn"), (2, "k", "warn"), (3, "j", "ok"), (4, "k", "breach"), (5, "j", "ok"), (6, "k", "warn")]
    rng = random.Random(3)
    many = [(r, f"k{rng.randint(0, 5)}", rng.choice(["warn", "breach", "ok"])) for r in range(60) for _ in range(rng.randint(0, 3))]
    quiet = [(r, f"k{(r > 20) + (r > 22) + (r > 40)}", "warn") for r in range(60)]
    got = {}
    for name, rows in {"beside": beside, "alone": alone, "status": status, "many": many, "quiet": quiet}.items():
        out = mo.throttled(spark.createDataFrame(rows, "run int, key string, status string"), "key", "status", "run")
        got[name] = sorted((r.run, r.key, r.status) for r in out.collect())
        assert got[name] == _one_run_at_a_time(rows), name
    assert [r for r, k, _ in got["beside"] if k == "k"] == [1, 5] and [r for r, _, _ in got["alone"]] == [1] and [r for r, _, _ in got["status"]] == [1, 4]
    none = spark.createDataFrame([], "run int, key string, status string")
    assert mo.throttled(none, "key", "status", "run").count() == 0


def test_runs_are_routed_one_by_one_over_a_log(spark, tmp_path):
    path, sent = str(tmp_path / "log"), []
    for run in [1, 2, 3, 4, 5, 5, 6]:
        alerts = spark.createDataFrame([("k|warn", "warn", "x"), (f"other{run}|breach", "breach", "y"), ("ok|ok", "ok", "z")], "alert_key string, status string, title string")
        sent.append(sorted(r.alert_key for r in mo.route_run(spark, alerts, path, f"2026-01-0{run}").collect()))
    assert ["k|warn" in s for s in sent] == [True, False, False, False, True, True, False]  # the repeated run sends the same again, once in the log
    assert all(f"other{run}|breach" in s for run, s in zip([1, 2, 3, 4, 5, 5, 6], sent, strict=True)) and spark.read.parquet(path).count() == 8


def test_schema_drift(spark):
    ddl = "field_id int, name string, type string"
    was = spark.createDataFrame([(1, "a", "int"), (2, "b", "int"), (3, "c", "int")], ddl)
    now = spark.createDataFrame([(1, "a", "bigint"), (2, "bb", "int"), (4, "d", "int"), (5, "_x", "int")], ddl)
    assert {r.field_id: r.change for r in mo.schema_drift(was, now).collect()} == {1: "type_changed", 2: "renamed", 3: "dropped", 4: "added"}


def test_versions_roll_back_and_expire(spark):
    rows = ve.versions_of(spark.createDataFrame([("k", "a", 1), ("k", "b", 5), ("j", "c", 7)], "key string, v string, at long"), ["key"], "at")
    back = ve.rolled_back(rows, 2, 10)
    state = lambda n: sorted(r.v for r in ve.as_of(back, n).collect())
    assert (state(2), state(7), state(10)) == (["a"], ["b", "c"], ["a"])
    snapshots = spark.createDataFrame([(n, f"2026-01-0{n}") for n in (1, 5, 7)], "version long, day string").selectExpr("version", "cast(day as timestamp_ntz) as committed_at")
    assert sorted(r.v for r in ve.expired(rows, snapshots, 6, keep=1).collect()) == ["b", "c"]
    assert ve.expired(rows, snapshots, 6).count() == 3
    assert ve.as_of_time(rows, snapshots, "1999-01-01").count() == 0
    assert sorted(r.v for r in ve.as_of_time(rows, snapshots, "2026-01-06").collect()) == ["b"]


def test_retrieval(spark):
    texts = spark.createDataFrame([(1, "a a b"), (2, "b c")], "id int, t string")
    tf = rt.terms(texts, "id", "t")
    df = rt.bm25_fit(tf, "id")
    assert {r.term: r.df for r in df.collect()} == {"a": 1, "b": 2, "c": 1}
    w = {(r.id, r.term): r.weight for r in rt.bm25_weights(tf, df, 2, 2.5).collect()}
    assert w[1, "a"] == pytest.approx(math.log(2) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2.5)))
    with pytest.raises(ValueError):
        rt.hybrid(F.lit(1.0), F.lit(1.0), 1.5)
    ranks = spark.createDataFrame([(1,), (2,), (4,), (None,)], "rank int")
    m = rt.hit_metrics(ranks).first()
    assert (m.hit_1, m.hit_3, m.mrr) == (0.25, 0.5, pytest.approx(1.75 / 4))
