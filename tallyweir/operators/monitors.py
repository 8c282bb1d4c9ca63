"""Monitors over metric histories, arrivals, findings and schemas; all tables or runs at once."""

from __future__ import annotations

import bisect

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Metrics that a baseline looks back on.
HISTORY = 14
#: Median deviation to standard deviation of a normal distribution.
MAD_SCALE = 1.4826


def count_drift(expected: Column, actual: Column, tolerance: float) -> Column:
    """Share of ``expected`` that ``actual`` is off; nothing expected allows nothing."""
    return F.when(expected == 0, actual == 0).otherwise(F.abs(expected - actual) <= expected * tolerance)


def quarantine_ratio_holds(read: Column, bad: Column, most: float = 0.01) -> Column:
    return F.when(read == 0, F.lit(True)).otherwise(bad <= read * most)


def trailing(metrics: DataFrame, key: str, at: str, value: str, n: int = HISTORY) -> DataFrame:
    """``history``: the last ``n`` non-null values of the key before each row; ``baseline``: their median."""
    before = Window.partitionBy(key).orderBy(at).rowsBetween(-n, -1)
    seen = metrics.where(F.col(value).isNotNull()).withColumn("history", F.collect_list(value).over(before))
    return seen.withColumn("baseline", median_of(F.col("history")))


def median_of(xs: Column) -> Column:
    s, n = F.sort_array(xs), F.size(xs)
    at = lambda k: F.get(s, k.cast("int")).cast("double")
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def robust_z(value: Column, history: Column) -> Column:
    """Distance from the median in robust deviations: the median deviation, or the mean one where that is 0, both scaled; with neither 0 or infinity."""
    mid = median_of(history)
    off = F.transform(history, lambda x: F.abs(x - mid))
    mad, mean = median_of(off), F.try_divide(F.aggregate(off, F.lit(0.0), lambda a, x: a + x), F.size(off))
    far = F.abs(value - mid)
    same = far <= F.greatest(F.greatest(F.abs(value), F.abs(mid)) * 1e-9, F.lit(1e-9))
    return F.when(mad > 0, F.try_divide(far, mad * MAD_SCALE)).when(mean > 0, F.try_divide(far, mean * MAD_SCALE)).when(same, F.lit(0.0)).when(F.size(history) > 0, F.lit(float("inf")))


def ratio_status(value: Column, baseline: Column) -> Column:
    """Under half the baseline is a breach, under 80 % a warning; a first run is ok."""
    return F.when(baseline.isNull(), "ok").when(value < baseline * 0.5, "breach").when(value < baseline * 0.8, "warn").otherwise("ok")


def shift_status(z: Column) -> Column:
    return F.when(z > 4, "breach").when(z > 3, "warn").otherwise("ok")


def first_seen(findings: DataFrame, key: str, run: str) -> DataFrame:
    """Each finding with the first run of its key and the days since."""
    first = F.min(run).over(Window.partitionBy(key))
    return findings.withColumns({"first_seen": first, "age": F.date_diff(run, first)})


def finding_diff(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """(key, state): new, cleared or open between two runs."""
    a, b = now.select(key).distinct().withColumn("_now", F.lit(True)), before.select(key).distinct().withColumn("_before", F.lit(True))
    state = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "cleared").otherwise("open")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def throttled(alerts: DataFrame, key: str, status: str, run: str, last: int = 3) -> DataFrame:
    """The warnings and breaches that are sent: an alert waits while it was sent in one of the ``last`` runs that sent anything.

    Whether a run sends anything depends on what earlier runs sent, so the runs are found by trial: with a guess of them, every
    key's own sequence of runs is folded by itself; runs are those that then send something, until these are the guess.
    What is sent up to the first wrong run is right already, so each trial settles one run more at least, and most settle
    all.  Of alerts only (key, status, run) is used, and each such triple comes out once at most.  The driver holds one
    number a run; alerts without a run are left out.
    """
    shown = alerts.where(F.col(status).isin("warn", "breach") & F.col(run).isNotNull()).select(key, status, run).distinct().persist()
    try:
        runs = [r[0] for r in shown.select(run).distinct().orderBy(run).collect()]
        senders = set(runs)
        while True:
            sent = _sent(shown, key, status, run, last, [r for r in runs if r in senders], runs).persist()
            now = {r[0] for r in sent.select(run).distinct().collect()}
            if now == senders:
                return sent
            sent.unpersist()
            senders = now
    finally:
        shown.unpersist()


def _sent(shown: DataFrame, key: str, status: str, run: str, last: int, senders: list, runs: list) -> DataFrame:
    """Those of ``shown`` that are sent if the runs that send something are ``senders``."""
    before = [bisect.bisect_left(senders, r) for r in runs]  # runs that sent something before each
    numbered = shown.sparkSession.createDataFrame(list(zip(runs, before, strict=True)), T.StructType([shown.schema[run], T.StructField("_before", T.IntegerType())]))
    seen = shown.join(F.broadcast(numbered), run).groupBy(key, status).agg(F.sort_array(F.collect_list(F.struct(F.col(run).alias("run"), F.col("_before").alias("n")))).alias("_seen"))
    start = F.struct(F.lit(None).cast("int").alias("n"), F.expr("slice(_seen, 1, 0)").alias("sent"))
    waits = lambda acc, x: acc["n"].isNotNull() & (x["n"] - acc["n"] <= last)
    fold = F.aggregate("_seen", start, lambda acc, x: F.when(waits(acc, x), acc).otherwise(F.struct(x["n"].alias("n"), F.concat(acc["sent"], F.array(x)).alias("sent"))))
    return seen.select(key, status, F.explode(fold["sent"]["run"]).alias(run))


def route(alerts: DataFrame, log: DataFrame, key: str, run: str, now, last: int = 3) -> DataFrame:
    """Of one run's alerts those to send: warnings and breaches whose key is in none of the ``last`` runs of the log before it.

    ``log`` holds what was sent, ``run`` being its partition, so that only these runs' files are read.
    """
    runs = log.where(F.col(run) < F.lit(now)).select(run).distinct().orderBy(F.desc(run)).limit(last)
    recent = log.join(F.broadcast(runs), run, "left_semi").select(key).distinct()  # at most ``last`` rows
    return alerts.where(F.col("status").isin("warn", "breach")).join(recent, key, "left_anti")


def route_run(spark: SparkSession, alerts: DataFrame, path: str, now: str, key: str = "alert_key", last: int = 3) -> DataFrame:
    """Sends one run's alerts: they are appended to the log at ``path`` under ``run_at`` and returned; a repeated run replaces its own part."""
    fields = T.StructType([*(f for f in alerts.schema.fields if f.name != "run_at"), T.StructField("run_at", T.StringType())])
    try:
        log = spark.read.schema(fields).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        log = spark.createDataFrame([], fields)
    sent = route(alerts.drop("run_at"), log, key, "run_at", now, last).withColumn("run_at", F.lit(now))
    sent.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_at").parquet(path)
    return spark.read.schema(fields).parquet(path).where(F.col("run_at") == now)


def reconcile(gold: DataFrame, other: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 0.0) -> DataFrame:
    """Each metric of both sides with its difference; ``mismatch`` where one is missing or over the tolerance."""
    g, o = (x.select(*keys, *[F.col(m).alias(f"{p}_{m}") for m in metrics]) for x, p in ((gold, "gold"), (other, "other")))
    both = g.join(o, keys, "full_outer")
    both = both.withColumns({f"delta_{m}": F.col(f"other_{m}") - F.col(f"gold_{m}") for m in metrics})
    bad = F.lit(False)
    for m in metrics:
        bad = bad | F.coalesce(F.abs(f"delta_{m}") > tolerance, F.lit(True))
    return both.withColumn("mismatch", bad)


def arrivals(rows: DataFrame, date: str, floor: int, as_of: str | None = None) -> DataFrame:
    """Every day from the first date to ``as_of`` (or the last date): rows, and gap, partial (fewer than ``floor``) or ok."""
    seen = rows.groupBy(F.col(date).alias("day")).agg(F.count("*").alias("n_rows")).where("day is not null")
    last = F.max("day") if as_of is None else F.greatest(F.max("day"), F.lit(as_of).cast("date"))
    days = seen.agg(F.min("day").alias("_a"), last.alias("_b")).where("_a is not null").select(F.explode(F.sequence("_a", "_b")).alias("day"))
    n = F.coalesce("n_rows", F.lit(0))
    return days.join(seen, "day", "left").select("day", n.alias("n_rows"), F.when(n == 0, "gap").when(n < floor, "partial").otherwise("ok").alias("status"))


def arrival_lag(rows: DataFrame, date: str, as_of: str, most_days: int, keys: list[str]) -> DataFrame:
    """By key: days from the newest date to ``as_of``, and whether they are too many."""
    lag = F.date_diff(F.lit(as_of).cast("date"), F.max(date))
    return rows.groupBy(*keys).agg(lag.alias("lag_days"), F.coalesce(lag > most_days, F.lit(True)).alias("late"))


def freshness(newest: Column, as_of: Column, warn_hours: float, error_hours: float) -> Column:
    hours = (as_of.cast("double") - newest.cast("double")) / 3600
    return F.when(newest.isNull() | (hours > error_hours), "error").when(hours > warn_hours, "warn").otherwise("ok")


def schema_drift(contract: DataFrame, observed: DataFrame) -> DataFrame:
    """Frames (field_id, name, type): dropped, renamed, type_changed and added columns (names not starting with _)."""
    c = contract.select("field_id", F.col("name").alias("_cn"), F.col("type").alias("_ct"))
    o = observed.select("field_id", F.col("name").alias("_on"), F.col("type").alias("_ot"))
    change = F.when(F.col("_on").isNull(), "dropped").when(F.col("_cn").isNull() & ~F.startswith("_on", F.lit("_")), "added").when(F.col("_cn") != F.col("_on"), "renamed").when(F.col("_ct") != F.col("_ot"), "type_changed")
    both = c.join(o, "field_id", "full_outer").withColumn("change", change)
    return both.where("change is not null").select("field_id", F.coalesce("_cn", "_on").alias("name"), "change", F.col("_on").alias("now"), F.col("_ct").alias("type_was"), F.col("_ot").alias("type_now"))


def schema_of(rows: DataFrame) -> DataFrame:
    """(field_id, name, type) of a frame; ids by place."""
    fields = [(k, f.name, f.dataType.simpleString()) for k, f in enumerate(rows.schema.fields)]
    return rows.sparkSession.createDataFrame(fields, "field_id int, name string, type string")
