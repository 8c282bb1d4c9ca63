"""Queries that run as streams over records made from the given events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.plans.base import Registry
from tallyweir.sources.models import CONVERSATION_SQL, conversation_events, table
from tallyweir.sources.shared import scratch
from tallyweir.streaming import changes as ch

FOUND = Registry()
_query = FOUND.add

_CHANGE_FIELDS = "impression_id string, event_id long, value double, referrer string"
_CHANGES_SQL = """cdc AS (SELECT user_id::VARCHAR AS impression_id, event_id, value, (epoch_us(ts) // 1000)::BIGINT AS source_ms, event_type, CASE event_type WHEN 'error' THEN 'd' WHEN 'signup' THEN 'c' ELSE 'u' END AS op FROM events)"""


def _envelopes(s, d) -> DataFrame:
    """One JSON envelope an event: errors delete, signups have an old name for a column, purchases are wrapped."""
    e = table(s, d, "events")
    kind = F.col("event_type")
    key = F.col("user_id").cast("string").alias("impression_id")
    after = F.struct(key, "event_id", F.when(kind != "signup", F.col("value")).alias("value"), F.when(kind == "signup", F.col("value")).alias("amount"), F.lit(1).alias("unknown"))
    op = F.when(kind == "error", "d").when(kind == "signup", "c").otherwise("u")
    body = F.struct(
        F.when(op == "d", F.struct(key, "event_id")).alias("before"), F.when(op != "d", after).alias("after"), op.alias("op"),
        F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("lsn")).alias("source"),
    )
    return e.select(F.when(kind == "purchase", F.to_json(F.struct(body.alias("payload")))).otherwise(F.to_json(body)).alias("value"))


def _decoded(raw: DataFrame) -> DataFrame:
    return ch.decode_changes(raw, _CHANGE_FIELDS, {"value": ["amount"]})


@_query("s16_decode_changes", f"WITH {_CHANGES_SQL} SELECT impression_id, event_id, CASE WHEN op <> 'd' THEN value END AS value, NULL::VARCHAR AS referrer, op, source_ms, event_id AS sequence, NULL::VARCHAR AS reason FROM cdc")
def _(s, d):
    return _decoded(_envelopes(s, d)).drop("event_ts", "raw")


@_query(
    "t13_cdc_running_table",
    f"WITH {_CHANGES_SQL}, ll AS (SELECT * FROM cdc QUALIFY row_number() OVER (PARTITION BY impression_id ORDER BY source_ms DESC, event_id DESC) = 1) SELECT impression_id, event_id, value FROM ll WHERE op <> 'd'",
)
def _(s, d):
    root = scratch(s, "running")
    _envelopes(s, d).repartition(4).write.text(f"{root}/in")  # files come in any order, so changes do too
    stream = _decoded(s.readStream.option("maxFilesPerTrigger", 1).text(f"{root}/in")).where("reason is null")
    kept = ch.KeyedTable(s, f"{root}/table", _CHANGE_FIELDS, ["impression_id"])
    ch.materialise(stream, kept, f"{root}/mark", compact_every=3).awaitTermination()
    return kept.current().drop("referrer")


@_query("s18_upsert_sink", f"WITH {CONVERSATION_SQL} SELECT account_id, event_type, count(*) AS n, max(latency_ms) AS most FROM conv GROUP BY ALL")
def _(s, d):
    root = scratch(s, "upsert")
    conversation_events(s, d).select("account_id", "event_type", "latency_ms").repartition(3).write.parquet(f"{root}/in")
    rows = s.readStream.schema("account_id string, event_type string, latency_ms long").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    kept = ch.KeyedTable(s, f"{root}/table", "account_id string, event_type string, n long, most long", ["account_id", "event_type"], order=("batch_no",))
    ch.upsert_sink(rows.groupBy("account_id", "event_type").agg(F.count("*").alias("n"), F.max("latency_ms").alias("most")), kept, f"{root}/mark", compact_every=2).awaitTermination()
    return kept.current()


@_query(
    "s19_counted_ingest",
    """SELECT CASE event_type WHEN 'error' THEN 'bad_time' WHEN 'signup' THEN 'malformed' ELSE 'valid' END AS outcome, count(*) AS n_rows, count(*) AS n_counted,
    max(CASE WHEN event_type NOT IN ('error', 'signup') THEN event_id END) AS last_event FROM events GROUP BY ALL""",
)
def _(s, d):
    root = scratch(s, "ingest")
    kind = F.col("event_type")
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    text = F.to_json(F.struct("event_id", F.when(kind == "error", F.replace(at, F.lit(" "), F.lit("T"))).otherwise(at).alias("event_ts")))
    table(s, d, "events").select(F.when(kind == "signup", F.substring(text, 1, 12)).otherwise(text).alias("value")).repartition(3).write.text(f"{root}/in")
    ingest = ch.CountedIngest(s, f"{root}/out", "event_id long, event_ts timestamp", ["event_ts"], "event_ts", delay_s=1e9)
    ingest.start(s.readStream.option("maxFilesPerTrigger", 1).text(f"{root}/in"), f"{root}/mark").awaitTermination()
    found = ingest.events().agg(F.lit("valid").alias("outcome"), F.count("*").alias("n_rows"), F.max("event_id").alias("last_event"))
    dead = ingest.dead_letters().groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("n_rows")).withColumn("last_event", F.lit(None).cast("long"))
    counts = ingest.counts().agg(*[F.sum(c).alias(c) for c in ("valid", "malformed", "bad_time", "late")]).unpivot([], ["valid", "malformed", "bad_time", "late"], "outcome", "n_counted")
    return found.unionByName(dead).join(counts, "outcome").select("outcome", "n_rows", "n_counted", "last_event")


@_query(
    "t12_changed_columns",
    f"WITH {_CHANGES_SQL} SELECT event_id, CASE WHEN op = 'u' THEN value END AS value FROM cdc",
)
def _(s, d):
    """Read without the column's other name: what was written under that reads null."""
    return ch.decode_changes(_envelopes(s, d), "event_id long, value double").select("event_id", "value")

