"""Contracts of tables as result rows, gates, freshness, drift and the findings made of them.

Rules of one table share one aggregation; only verdicts that stop a publication reach the driver.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweir.functions.scalars import clamp_delta, date_prefix, pipe_key
from tallyweir.operators import monitors as mo
from tallyweir.operators.rules import volume_verdict


@dataclass(frozen=True)
class Rule:
    """``check``: not_null, unique, accepted_values, range, freshness or row_count."""

    check: str
    column: str = ""
    values: tuple = ()
    low: float | None = None
    high: float | None = None
    days: int = 0
    severity: str = "error"


def _measure(rule: Rule, as_of: str) -> tuple[Column, Column]:
    """(metric, does it hold) as aggregates."""
    c, n = F.col(rule.column) if rule.column else F.lit(1), F.count("*")
    if rule.check == "not_null":
        metric = F.count_if(c.isNull())
        return metric, metric == 0
    if rule.check == "unique":
        metric = F.count(c) - F.count_distinct(c)
        return metric, metric == 0
    if rule.check == "accepted_values":
        metric = F.count_if(~c.isin(*rule.values))
        return metric, metric == 0
    if rule.check == "range":
        outside = F.lit(False)
        for bound, beyond in ((rule.low, c < rule.low if rule.low is not None else None), (rule.high, c > rule.high if rule.high is not None else None)):
            outside = outside | beyond if bound is not None else outside
        metric = F.count_if(outside)
        return metric, (metric == 0) & (F.count(c) > 0)
    if rule.check == "freshness":
        day = date_prefix(c.cast("string"))
        lag = F.date_diff(F.lit(as_of).cast("date"), F.max(day))
        return lag, F.coalesce(lag <= rule.days, F.lit(False)) & (F.count_if(c.isNotNull() & day.isNull()) == 0)
    if rule.check == "row_count":
        return n, n >= rule.low
    raise ValueError(f"no check is called {rule.check!r}")


def duplicates_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, duplicates): non-null values of each column less its distinct ones, all columns in one scan and one shuffle.

    Only (column, two 64-bit hashes of the value) is shuffled, equal ones counted before it, instead of each row once for
    every column. Of n values about n^2 / 2^129 pairs fall together.
    """
    value = lambda c: F.struct(F.lit(c).alias("column"), F.xxhash64(F.lit(1), c).alias("_h"), F.xxhash64(c, F.lit("2")).alias("_g"), F.col(c).isNotNull().alias("_there"))
    pairs = rows.select(F.explode(F.array(*map(value, columns))).alias("_v")).select("_v.*").where("_there")
    seen = pairs.groupBy("column", "_h", "_g").agg(F.count("*").alias("_n")).groupBy("column").agg(F.sum(F.col("_n") - 1).alias("duplicates"))
    names = rows.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(seen, "column", "left").select("column", F.coalesce("duplicates", F.lit(0)).cast("long").alias("duplicates"))


def contract_results(rows: DataFrame, table: str, rules: list[Rule], as_of: str = "1970-01-01") -> DataFrame:
    """(table_name, check, column, metric, status), one row per rule; a rule on an absent column fails without a metric."""
    there = [r for r in rules if not r.column or r.column in rows.columns]
    parts = [F.struct(F.lit(r.check).alias("check"), F.lit(r.column).alias("column"), F.lit(None).cast("long").alias("metric"), F.lit(r.severity).alias("status")) for r in rules if r not in there]
    several = [r for r in there if r.check == "unique"]
    several = several if len(several) > 1 else []
    for r in (r for r in there if r not in several):
        metric, holds = _measure(r, as_of)
        status = F.when(holds, "ok").otherwise(r.severity)
        parts.append(F.struct(F.lit(r.check).alias("check"), F.lit(r.column).alias("column"), metric.cast("long").alias("metric"), status.alias("status")))
    found = []
    if parts:
        found.append(rows.agg(F.array(*parts).alias("_r")).select(F.inline("_r")))
    if several:
        severities = rows.sparkSession.createDataFrame([(r.column, r.severity) for r in several], "column string, severity string")
        unique = duplicates_of(rows, sorted({r.column for r in several})).join(severities, "column")
        found.append(unique.select(F.lit("unique").alias("check"), "column", F.col("duplicates").alias("metric"), F.when(F.col("duplicates") == 0, "ok").otherwise(F.col("severity")).alias("status")))
    return functools.reduce(DataFrame.unionByName, found).select(F.lit(table).alias("table_name"), "*")


def gate_publish(rows: DataFrame, table: str, rules: list[Rule], path: str, as_of: str = "1970-01-01") -> None:
    """Overwrites ``path`` if no rule fails with an error; else raises with all that fail, and leaves it as it is."""
    failed = contract_results(rows, table, rules, as_of).where("status = 'error'").orderBy("check", "column").collect()  # one row a rule
    if failed:
        raise ValueError(f"{table}: " + "; ".join(f"{r['check']}({r['column']}) = {r['metric']}" for r in failed))
    rows.write.mode("overwrite").parquet(path)


def slice_volume_audit(expected: DataFrame, manifests: DataFrame, days: int = 7, most_bad: float = 0.01) -> DataFrame:
    """Verdict of each expected slice: missing, quarantine, no_baseline, anomaly or ok, in this order.

    ``manifests`` has page_type, hour, date, rows_read, rows_written, rows_quarantined; the baseline is the median of the days before.
    """
    keys = ["page_type", "hour", "date"]
    both = expected.select(*keys, F.lit(True).alias("_wanted")).join(manifests, keys, "full_outer")
    before = Window.partitionBy("page_type", "hour").orderBy(F.unix_date("date")).rangeBetween(-days, -1)
    both = both.withColumn("baseline", mo.median_of(F.collect_list("rows_written").over(before))).where("_wanted")
    bad = ~mo.quarantine_ratio_holds(F.col("rows_read"), F.col("rows_quarantined"), most_bad)
    status = F.when(F.col("rows_written").isNull(), "missing").when(bad, "quarantine").otherwise(volume_verdict(F.col("rows_written"), F.col("baseline")))
    return both.select(*keys, "rows_written", "baseline", status.alias("status"))


def run_freshness(statuses: DataFrame, job: str, as_of: str, sla_hours: float) -> DataFrame:
    """(job, hours, status) by the newest ``completed`` status (status, updated_at) of each job; a job without one is late."""
    newest = F.max(F.when(F.col("status") == "completed", F.col("updated_at")))
    hours = F.round((F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(newest)) / 3600, 2)
    return statuses.groupBy(job).agg(hours.alias("hours"), F.when(hours <= sla_hours, "ok").otherwise("late").alias("status"))


def source_freshness(rows: DataFrame, source: str, loaded_at: str, as_of: str, warn_hours: float = 2, error_hours: float = 24) -> DataFrame:
    status = mo.freshness(F.max(F.col(loaded_at).cast("timestamp")), F.lit(as_of).cast("timestamp"), warn_hours, error_hours)
    return rows.groupBy(source).agg(status.alias("status"))


KINDS = ("row_count", "cardinality", "distribution_shift", "null_rate", "duplicates")


def monitor_status(kind: str, value: Column, history: Column, max_absolute: float | None = None) -> Column:
    """ok, warn or breach of a metric by its kind; a value over ``max_absolute`` breaches whatever its history."""
    if kind not in KINDS:
        raise ValueError(f"no monitor is of kind {kind!r}")
    if kind == "duplicates":
        status = F.when(value > 0, "breach").otherwise("ok")
    elif kind in ("row_count", "cardinality"):
        status = mo.ratio_status(value, mo.median_of(history))
    else:
        status = mo.shift_status(mo.robust_z(value.cast("double"), history))
    return status if max_absolute is None else F.when(value > max_absolute, "breach").otherwise(status)


@dataclass(frozen=True)
class Monitor:
    name: str
    kind: str
    metric: str
    max_absolute: float | None = None


def run_monitors(feed: str, rows: DataFrame, run: str, monitors: list[Monitor]) -> DataFrame:
    """(feed, monitor, run, metric, status) of every run; a monitor that can't be planned is one breach row, the others go on."""
    results = []
    for m in monitors:
        try:
            per = rows.groupBy(F.col(run).alias("run")).agg(F.expr(m.metric).cast("double").alias("metric"))
            seen = mo.trailing(per.withColumn("_feed", F.lit(feed)), "_feed", "run", "metric")
            part = seen.select("run", "metric", monitor_status(m.kind, F.col("metric"), F.col("history"), m.max_absolute).alias("status"))
            part.schema  # noqa: B018  names and types are checked here
        except Exception as problem:  # noqa: BLE001  whatever is wrong with one monitor
            part = rows.sparkSession.range(1).select(F.lit(None).cast(rows.schema[run].dataType).alias("run"), F.lit(None).cast("double").alias("metric"), F.lit("breach").alias("status"))
            part = part.withColumn("detail", F.lit(type(problem).__name__))
        part = part if "detail" in part.columns else part.withColumn("detail", F.lit(None).cast("string"))
        results.append(part.select(F.lit(feed).alias("feed"), F.lit(m.name).alias("monitor"), "run", "metric", "status", "detail"))
    return functools.reduce(DataFrame.unionByName, results)


def batch_against_median(batches: DataFrame, key: str, batch: str, value: str) -> DataFrame:
    """(key, batch, value, baseline): the newest batch of each key and the median of all earlier ones."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(batch)))
    ranked = batches.withColumn("_k", place)
    return ranked.groupBy(key).agg(
        F.max(batch).alias(batch), F.max(F.when(F.col("_k") == 1, F.col(value))).alias(value), F.median(F.when(F.col("_k") > 1, F.col(value))).alias("baseline")
    )


def volume_collapse(batches: DataFrame, key: str, batch: str, value: str) -> DataFrame:
    """The keys whose newest batch has less than half the median of the earlier ones."""
    return batch_against_median(batches, key, batch, value).where(F.col(value) < F.col("baseline") * 0.5)


def rename_map(history: DataFrame, table: str) -> DataFrame:
    """(table, old_name, new_name): every past name of a field id (version, field_id, name) that the newest version still has."""
    newest = history.groupBy(table).agg(F.max("version").alias("version"))
    now = history.join(newest, [table, "version"]).select(table, "field_id", F.col("name").alias("new_name"))
    return history.select(table, "field_id", F.col("name").alias("old_name")).distinct().join(now, [table, "field_id"]).where("old_name <> new_name").select(table, "field_id", "old_name", "new_name")


def enum_drift(rows: DataFrame, column: str, registered: list, most: int = 200) -> DataFrame:
    """(finding, value): new values, or one row that says why they can't be told. It reports and stops nothing."""
    error = lambda what: rows.sparkSession.range(1).select(F.lit(what).alias("finding"), F.lit(None).cast("string").alias("value"))
    if column not in rows.columns:
        return error("column_absent")
    kind = rows.schema[column].dataType.typeName()
    if kind in ("array", "map", "struct", "binary", "variant"):
        return error("not_comparable")
    seen = rows.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    n = seen.agg(F.count("*").alias("_n"))
    verdict = n.select(F.when(F.col("_n") == 0, "no_values").when(F.col("_n") > most, "too_many_values").alias("finding"), F.lit(None).cast("string").alias("value")).where("finding is not null")
    new = seen.where(~F.col("value").isin([str(v) for v in registered])).where(n.scalar() <= most)
    return verdict.unionByName(new.select(F.lit("new_value").alias("finding"), "value"))


_WIDER = (("int", "bigint"), ("float", "double"))


def severity(kind: Column, change: Column, was: Column, now: Column) -> Column:
    """What a finding means: breaking, additive, renaming, widening, enum_drift, benign."""
    widening = functools.reduce(lambda a, b: a | b, [(was == x) & (now == y) for x, y in _WIDER])
    return (
        F.when(kind.isin("monitor", "volume", "stale", "corrupt"), "breaking")
        .when((kind == "enum") & change.isin("column_absent", "no_values"), "breaking")  # the watch sees nothing
        .when((kind == "enum") & change.isin("not_comparable", "too_many_values"), "benign")  # no column to watch
        .when(kind == "enum", "enum_drift")
        .when(kind != "schema", "benign")
        .when(change == "added", "additive")
        .when((change == "renamed") & (was == now), "renaming")
        .when((change == "type_changed") & widening, "widening")
        .when(change.isin("dropped", "renamed", "type_changed"), "breaking")
        .otherwise("benign")
    )


def classify_findings(findings: DataFrame) -> DataFrame:
    """Findings (table_name, kind, column, change, monitor, type_was, type_now) with their key and severity."""
    c = F.col
    key = pipe_key(c("table_name"), c("kind"), c("column"), c("change"), c("monitor"))
    return findings.withColumns({"finding_key": key, "severity": severity(c("kind"), c("change"), c("type_was"), c("type_now"))})


def breaches_as_findings(results: DataFrame) -> DataFrame:
    """Of monitor results only breaches are findings."""
    none = F.lit(None).cast("string")
    return results.where("status = 'breach'").select(
        F.col("feed").alias("table_name"), F.lit("monitor").alias("kind"), none.alias("column"), F.lit("breach").alias("change"), "monitor", none.alias("type_was"), none.alias("type_now")
    )


def report_monitors(results: DataFrame, as_of: str) -> DataFrame:
    """Each monitor's newest result up to ``as_of`` with the change since the run before."""
    until = results.where(F.col("run") <= F.lit(as_of).cast("date"))
    ordered = Window.partitionBy("feed", "monitor").orderBy("run")
    rows = until.withColumns({"delta": clamp_delta(F.col("metric"), F.lag("metric").over(ordered)), "_last": F.lead("run").over(ordered)})
    return rows.where("_last is null").select("feed", "monitor", "run", "metric", "status", "delta")


def report_incidents(findings: DataFrame, key: str, run: str, as_of: str) -> DataFrame:
    """Keys found in the newest run up to ``as_of``: first run, age in days, whether they are new since the run before."""
    until = findings.where(F.col(run) <= F.lit(as_of).cast("date")).select(key, run).distinct()
    newest = until.agg(F.max(run)).scalar()
    before = until.where(F.col(run) < newest).agg(F.max(run)).scalar()
    rows = until.groupBy(key).agg(F.min(run).alias("first_seen"), F.max(run).alias("_last"), F.max(F.col(run) == before).alias("_was")).where(F.col("_last") == newest)
    return rows.select(key, "first_seen", F.date_diff("_last", "first_seen").alias("age"), F.when(F.coalesce("_was", F.lit(False)), "open").otherwise("new").alias("state"))


def daily_report(findings: DataFrame, monitors: DataFrame, alerts: DataFrame, runs: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """The tables of one day's report, from the logs of findings (finding_key, run, at, ...), monitors, alerts (run, ...) and runs (run).

    findings: those of the day, the last write of each key, with their first run, age in days and whether the run before had
    them; cleared: keys of the run before that the day has not, if it ran; monitors: as ``report_monitors``; alerts: those of
    the day; run: one row, whether the day ran and which run was before it.
    """
    day = F.lit(as_of).cast("date")
    before = runs.where(F.col("run") < day).agg(F.max("run"))
    header = runs.agg(F.coalesce(F.bool_or(F.col("run") == day), F.lit(False)).alias("ran"), F.max(F.when(F.col("run") < day, F.col("run"))).alias("previous_run")).select(day.alias("as_of"), "ran", "previous_run")
    until = findings.where(F.col("run") <= day)
    keys = until.groupBy("finding_key").agg(
        F.min("run").alias("first_seen"), F.coalesce(F.bool_or(F.col("run") == before.scalar()), F.lit(False)).alias("_was"), F.bool_or(F.col("run") == day).alias("_is")
    )
    today = latest_per_key_run(until.where(F.col("run") == day).withColumn("_all", F.struct(*findings.columns)), ["finding_key"], "at", "_all").drop("_all")
    told = today.join(keys, "finding_key").select(*findings.columns, "first_seen", F.date_diff(day, "first_seen").alias("age"), F.when(F.col("_was"), "open").otherwise("new").alias("state"))
    cleared = keys.where("_was and not _is").crossJoin(F.broadcast(header.where("ran").select("previous_run"))).select("finding_key", "first_seen", F.col("previous_run").alias("last_seen"))  # one row
    return {"run": header, "findings": told, "cleared": cleared, "monitors": report_monitors(monitors, as_of), "alerts": alerts.where(F.col("run") == day)}


def latest_per_key_run(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last write of each key within one day."""
    place = F.row_number().over(Window.partitionBy(*keys, F.to_date(at)).orderBy(F.desc(at), F.desc(tie)))
    return rows.withColumn("_k", place).where("_k = 1").drop("_k")
