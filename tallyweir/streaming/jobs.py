"""Conversation and change streams; each transformation also takes a batch frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def parse_json(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON text to columns; malformed records go, unknown fields are ignored, missing ones are null."""
    fields = T.StructType.fromDDL(schema)
    bad = "_bad"
    parsed = F.from_json(column, T.StructType([*fields.fields, T.StructField(bad, T.StringType())]), {"columnNameOfCorruptRecord": bad})
    return raw.select(parsed.alias("_j")).where(f"_j is not null and _j.{bad} is null").select("_j.*").drop(bad)


def malformed(raw: DataFrame, column: str = "value") -> DataFrame:
    """The records that ``parse_json`` leaves out."""
    bad = F.from_json(column, "_bad string", {"columnNameOfCorruptRecord": "_bad"})
    return raw.where(F.col(column).isNull() | bad.isNull() | bad["_bad"].isNotNull())


def watermarked(events: DataFrame, ts: str = "event_ts", delay: str = "30 seconds") -> DataFrame:
    return events.withWatermark(ts, delay)


def minute_rollup(events: DataFrame) -> DataFrame:
    """One-minute windows by account and event type; latencies are those of responses, 0.0 without one."""
    is_response = F.col("event_type") == "agent_response"
    latency = F.when(is_response, F.col("latency_ms"))
    kind = lambda x: F.count_if(F.col("event_type") == x)
    out = events.groupBy(F.window("event_ts", "1 minute").alias("_w"), "account_id", "event_type").agg(
        F.count("*").alias("events"), kind("conversation_started").alias("started"), kind("escalation").alias("escalated"), kind("resolution").alias("resolved"),
        F.coalesce(F.round(F.avg(latency), 4), F.lit(0.0)).alias("avg_latency"), F.coalesce(F.max(latency), F.lit(0)).alias("max_latency"),
    )
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def cdc_minute_counts(changes: DataFrame, ts: str = "event_ts") -> DataFrame:
    """Events and distinct impressions by page and minute, deletes left out; two aggregations, as streams have no distinct count."""
    one = changes.where("op <> 'd'").groupBy(F.window(ts, "1 minute").alias("_w"), "page_type", "impression_id").agg(F.count("*").alias("_n"))
    two = one.groupBy(F.window(F.window_time("_w"), "1 minute").alias("_w"), "page_type").agg(F.sum("_n").alias("events"), F.count("*").alias("impressions"))
    return two.select("page_type", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "events", "impressions")


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Replayed events collapse within the watermark; on a batch frame, everywhere."""
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def current_rows(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of each key, deleted keys left out; ``order`` is the source's."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return changes.withColumn("_k", last).where("_k = 1 and op <> 'd'").drop("_k", "op")


def append_sink(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Closed windows are appended once; the checkpoint and the file sink's log make restarts exact."""
    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).format("parquet").start(path)


def batch_sink(rows: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda x: x, **trigger) -> StreamingQuery:
    """Each micro-batch, after ``step``, replaces its own ``batch_id`` partition, so that a replay counts once.

    With an aggregation as ``step`` the table holds partial states to be merged at read;
    with rows by key it holds versions of which ``latest_versions`` reads the last.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = step(batch).withColumn("batch_id", F.lit(batch_id).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def latest_versions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the newest batch for each key."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch_id")))
    return rows.withColumn("_k", last).where("_k = 1").drop("_k", "batch_id")


def dedup_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each whole sort key, at read or compaction; exact where appends were repeated."""
    return rows.dropDuplicates(keys)


def backfilled(view: DataFrame, older: DataFrame, state: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A state table with the states of rows that are older than it, made by the same aggregation."""
    return view.unionByName(state(older))
