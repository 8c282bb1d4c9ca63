"""Contracts, gates, monitors, drift, findings."""

import datetime

import pytest

from tallyweir.operators import contracts as co
from tallyweir.operators import monitors as mo

RULES = [
    co.Rule("not_null", "k"), co.Rule("unique", "k"), co.Rule("accepted_values", "v", ("a", "b"), severity="warn"), co.Rule("range", "n", low=0, high=9),
    co.Rule("range", "nothing", low=0), co.Rule("freshness", "day", days=3), co.Rule("row_count", low=3), co.Rule("unique", "absent"),
]


def _rows(spark):
    rows = [(1, "a", 3, None, "2026-01-05"), (1, "c", 30, None, "2026-01-04T08:00:00"), (None, "b", 4, None, "NOPE")]
    return spark.createDataFrame(rows, "k int, v string, n int, nothing int, day string")


def test_results_of_each_rule(spark):
    got = {(r["check"], r["column"]): (r["metric"], r["status"]) for r in co.contract_results(_rows(spark), "t", RULES, "2026-01-06").collect()}
    assert got == {
        ("not_null", "k"): (1, "error"), ("unique", "k"): (1, "error"), ("accepted_values", "v"): (1, "warn"), ("range", "n"): (1, "error"),
        ("range", "nothing"): (0, "error"), ("freshness", "day"): (1, "error"), ("row_count", ""): (3, "ok"), ("unique", "absent"): (None, "error"),
    }
    with pytest.raises(ValueError):
        co.contract_results(_rows(spark), "t", [co.Rule("odd", "k")])


def test_gate_writes_only_clean_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    co.gate_publish(_rows(spark), "t", [co.Rule("row_count", low=3)], path)
    with pytest.raises(ValueError, match=r"not_null\(k\) = 1; unique\(k\) = 1"):
        co.gate_publish(_rows(spark).limit(0).unionByName(_rows(spark)), "t", RULES[:2], path)
    assert spark.read.parquet(path).count() == 3


def test_monitors(spark):
    day = lambda k: datetime.date(2026, 1, k)
    rows = spark.createDataFrame([(day(k), n) for k, count in ((1, 10), (2, 10), (3, 4), (4, 9)) for n in range(count)], "run date, n int")
    monitors = [co.Monitor("rows", "row_count", "count(*)"), co.Monitor("cap", "row_count", "count(*)", max_absolute=9), co.Monitor("broken", "row_count", "sum(nope)")]
    got = {(r.monitor, r.run.day if r.run else None): r.status for r in co.run_monitors("f", rows, "run", monitors).collect()}
    assert got == {("rows", 1): "ok", ("rows", 2): "ok", ("rows", 3): "breach", ("rows", 4): "ok", ("cap", 1): "breach", ("cap", 2): "breach", ("cap", 3): "breach", ("cap", 4): "ok", ("broken", None): "breach"}
    found = co.classify_findings(co.breaches_as_findings(co.run_monitors("f", rows, "run", monitors[:1]))).first()
    assert (found.finding_key, found.severity) == ("f|monitor||breach|rows", "breaking")
    with pytest.raises(ValueError):
        co.run_monitors("f", rows, "run", []) if False else co.monitor_status("odd", mo.F.col("n"), mo.F.array())


def test_enum_drift(spark):
    rows = spark.createDataFrame([("a", [1], None), ("g", [2], None)], "e string, l array<int>, nothing string")
    told = lambda c, *known, **more: [tuple(r) for r in co.enum_drift(rows, c, list(known), **more).collect()]
    assert told("e", "a") == [("new_value", "g")] and told("e", "a", "g") == []
    assert told("e", most=1) == [("too_many_values", None)] and told("nothing") == [("no_values", None)]
    assert told("l") == [("not_comparable", None)] and told("absent") == [("column_absent", None)]


def test_audit_of_slices(spark):
    day = lambda k: datetime.date(2026, 1, k)
    rows = [(1, 5, day(k), n, n, bad) for k, n, bad in ((1, 10, 0), (2, 10, 0), (3, 3, 0), (4, 10, 5))]
    manifests = spark.createDataFrame(rows, "page_type int, hour int, date date, rows_read long, rows_written long, rows_quarantined long")
    expected = spark.createDataFrame([(1, 5, day(k)) for k in range(1, 6)], "page_type int, hour int, date date")
    got = {r.date.day: r.status for r in co.slice_volume_audit(expected, manifests).collect()}
    assert got == {1: "no_baseline", 2: "ok", 3: "anomaly", 4: "quarantine", 5: "missing"}


def test_many_distinct_counts_in_one_scan(spark):
    columns = [f"c{k}" for k in range(10)]
    rows = spark.createDataFrame([[None if (k + j) % 13 == 0 else (k if j % 2 else k % (50 + j)) for j in range(10)] for k in range(400)], ", ".join(f"{c} long" for c in columns))
    got = {r["column"]: (r.metric, r.status) for r in co.contract_results(rows, "t", [co.Rule("unique", c) for c in columns] + [co.Rule("not_null", "c0")]).where("check = 'unique'").collect()}
    for j, c in enumerate(columns):
        seen = [r[j] for r in rows.collect() if r[j] is not None]
        assert got[c] == (len(seen) - len(set(seen)), "ok" if len(seen) == len(set(seen)) else "error")
    plan = co.contract_results(rows, "t", [co.Rule("unique", c) for c in columns])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert {r.metric for r in co.contract_results(rows.limit(0), "t", [co.Rule("unique", c) for c in columns]).collect()} == {0}
