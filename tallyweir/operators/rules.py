"""Checks on tables: contracts, volumes, drift; every check is one aggregate."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweir.functions.scalars import clamp_delta, date_prefix
from tallyweir.operators.monitors import median_of


def contract_counts(rows: DataFrame, required: list[str], key: str, accepted: dict[str, list]) -> DataFrame:
    """One row: rows, nulls of each required column, duplicates of the key, values not accepted."""
    return rows.agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required],
        (F.count(key) - F.count_distinct(key)).alias("duplicate_keys"), *[F.count_if(~F.col(c).isin(v)).alias(f"bad_{c}") for c, v in accepted.items()],
    )


def volume_verdict(n: Column, baseline: Column) -> Column:
    """Against the median of earlier days: under half or over twice is an anomaly."""
    off = (n < baseline * 0.5) | (n > baseline * 2)
    return F.when(n == 0, "anomaly").when(baseline.isNull() | (baseline == 0), "no_baseline").when(off, "anomaly").otherwise("ok")


def manifest_baseline(slices: DataFrame, days: int = 7) -> DataFrame:
    """Slices with the median rows of the same page and hour on the days before; missing days are skipped."""
    before = Window.partitionBy("page_type", "hour").orderBy(F.unix_date("date")).rangeBetween(-days, -1)
    seen = slices.withColumn("_seen", F.collect_list("rows_written").over(before))
    return seen.withColumns({"days_found": F.size("_seen").cast("long"), "baseline": median_of(F.col("_seen"))}).drop("_seen")


def check_volume(slices: DataFrame, days: int = 7) -> DataFrame:
    """Slices (page_type, hour, date, rows_written) with the median of the same hour on earlier days."""
    base = manifest_baseline(slices, days).drop("days_found")
    return base.withColumn("status", volume_verdict(F.col("rows_written"), F.col("baseline")))


def date_health(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """By key: non-null texts that begin with no date, and the newest date."""
    day = date_prefix(F.col(column))
    return rows.groupBy(*keys).agg(F.count_if(F.col(column).isNotNull() & day.isNull()).alias("unparsed"), F.max(day).alias("newest"))


def new_values(observed: DataFrame, column: str, registered: list) -> DataFrame:
    return observed.select(column).distinct().where(F.col(column).isNotNull() & ~F.col(column).isin(registered))


def run_over_run(metrics: DataFrame, key: str, at: str, value: str) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(key).orderBy(at))
    return metrics.withColumn("previous", before).withColumn("delta", clamp_delta(F.col(value), before))


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` replace those of ``target`` with equal keys, others are added.

    A source with null or repeated keys raises, so that a replay gives the same table; null keys of the target stay.
    """
    missing = [k for k in keys if k not in source.columns or k not in target.columns]
    if missing:
        raise ValueError(f"no key column {missing}")
    problem = F.when(F.max(functools.reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])), "null keys").when(F.max("_n") > 1, "repeated keys")
    found = source.groupBy(*keys).agg(F.count("*").alias("_n")).agg(problem.alias("problem")).first()["problem"]
    if found:
        raise ValueError(f"the source has {found}")
    kept = target.join(source.select(*keys), keys, "left_anti")
    return kept.unionByName(source)


def delete_where(target: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not true stay, null included."""
    return target.where(~F.coalesce(predicate, F.lit(False)))
