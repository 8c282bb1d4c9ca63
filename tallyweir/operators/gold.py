"""Slices of gold tables, with parameters that may be left out, and staging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.scalars import safe_date, safe_event_ts


def optional(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns have the values given; a value of None filters nothing."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value).cast(rows.schema[column].dataType))
    return rows


def slice_scan(events: DataFrame, page_type: int | None = None, date: str | None = None, hour: int | None = None) -> DataFrame:
    """Filters on the partition columns themselves, so that a partitioned table is pruned."""
    return optional(events, page_type=page_type, date=date, hour=hour)


def funnel_slice(funnel: DataFrame, page_type: int) -> DataFrame:
    return optional(funnel, page_type=page_type).orderBy("event_type")


def summary_slice(summary: DataFrame, page_type: int | None) -> DataFrame:
    return optional(summary, page_type=page_type).orderBy("page_type")


def traffic_range(traffic: DataFrame, first: str, last: str, page_type: int | None) -> DataFrame:
    """Hours of the days from ``first`` to ``last``, both included."""
    sql = "SELECT * FROM {rows} WHERE date BETWEEN CAST(:first AS DATE) AND CAST(:last AS DATE) AND (:page IS NULL OR page_type = :page) ORDER BY date, hour, page_type"
    return traffic.sparkSession.sql(sql, args={"first": first, "last": last, "page": page_type}, rows=traffic)


def newest(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest ``by``, in ascending order."""
    return rows.orderBy(F.desc(by)).limit(n).orderBy(by)


def stage_impressions(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Raw rows (date as text, hour, min, second, loaded_at) with a date and a timestamp that are null where they can't be."""
    day = safe_date(F.col("date"))
    at = safe_event_ts(day, F.col("hour"), F.col("min"), F.col("second"))
    return raw.select(*keys, day.alias("date"), "hour", F.col("min").alias("minute"), "second", at.alias("event_ts"), "loaded_at")


def reconcile_left(gold: DataFrame, other: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Each metric of the gold rows with the other side's and the difference."""
    g, o = (x.select(*keys, *[F.col(m).alias(f"{p}_{m}") for m in metrics]) for x, p in ((gold, "gold"), (other, "other")))
    return g.join(o, keys, "left").withColumns({f"delta_{m}": F.col(f"other_{m}") - F.col(f"gold_{m}") for m in metrics})


def filter_sink(events: DataFrame, path: str, least: str = "d") -> DataFrame:
    """Writes the events of stage ``least`` and deeper to ``path`` and gives them as they are stored."""
    deep = events.where(F.col("event_type") >= least)
    deep.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return events.sparkSession.read.schema(deep.schema).parquet(path)
