"""The event models, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per funnel event of an impression."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    key = F.col("o_orderkey")
    return lines.join(orders, lines["l_orderkey"] == key).select(
        F.col("o_custkey").cast("string").alias("user_id"),
        key.cast("string").alias("impression_id"),
        (key % 3 + 1).cast("int").alias("page_type"),
        F.to_date("o_orderdate").alias("date"),
        (key % 24).cast("int").alias("hour"),
        (F.col("l_partkey") % 60).cast("int").alias("min"),
        (F.col("l_suppkey") % 60).cast("int").alias("second"),
        F.substring(F.lit("abcdefg"), F.col("l_linenumber"), F.lit(1)).alias("event_type"),
    )


def funnel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impressions(spark, sf_dir).where("event_type <= 'f'")


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    names = {"signup": "conversation_started", "click": "message_sent", "view": "agent_response", "purchase": "resolution", "error": "escalation"}
    mapped = F.coalesce(*[F.when(kind == a, F.lit(b)) for a, b in names.items()])
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id",
        F.concat(F.lit("acct_"), F.lpad((F.col("user_id") % 25).cast("string"), 4, "0")).alias("account_id"),
        F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("conversation_id"),
        mapped.alias("event_type"),
        F.col("ts").alias("event_ts"),
        F.when(kind == "view", F.floor(F.col("value") * 50)).otherwise(F.lit(0)).cast("long").alias("latency_ms"),
        F.element_at(F.array(*map(F.lit, ("chat", "voice", "email", "sms", "api"))), k % 5 + 1).alias("channel"),
        F.element_at(F.array(*map(F.lit, ("agent-lg-v3", "agent-lg-v2", "agent-sm-v3", "agent-voice-v1"))), k % 4 + 1).alias("model"),
        F.concat(F.lit("intent_"), (k % 12).cast("string")).alias("intent"),
        F.col("user_id").cast("string").alias("user_id"),
        k.cast("long").alias("prompt_tokens"),
        F.floor("value").cast("long").alias("completion_tokens"),
        ((k - 50) / 50).cast("double").alias("sentiment"),
        (kind == "purchase").cast("int").alias("resolved"),
    )


MEASURES = ("latency_ms", "prompt_tokens", "completion_tokens", "sentiment", "resolved")


def naive_conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events with every column a text and the measures packed in one JSON text."""
    e = conversation_events(spark, sf_dir)
    plain = [F.col(c).cast("string").alias(c) for c in e.columns if c not in MEASURES]
    return e.select(*plain, F.to_json(F.struct(*MEASURES)).alias("payload"))


def staged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with dates as text, some of which are no dates."""
    key = F.col("o_orderkey")
    day = F.when(key % 97 == 0, "NOPE").when(key % 89 == 0, "2026-13-40").otherwise(F.to_date("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", day.alias("raw"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("country")
    )


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests: rows of each slice."""
    return impressions(spark, sf_dir).groupBy("page_type", "hour", "date").agg(F.count("*").alias("rows_written"))


IMPRESSIONS_SQL = """imp AS (SELECT o_custkey::VARCHAR AS user_id, o_orderkey::VARCHAR AS impression_id, (o_orderkey % 3 + 1)::INT AS page_type,
  o_orderdate::DATE AS date, (o_orderkey % 24)::INT AS hour, (l_partkey % 60)::INT AS min, (l_suppkey % 60)::INT AS second,
  substr('abcdefg', l_linenumber, 1) AS event_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fun AS (SELECT * FROM imp WHERE event_type <= 'f'),
agg AS (SELECT user_id, impression_id, page_type, date, hour, count(*) AS event_count, count(DISTINCT event_type) AS distinct_events,
  min(second) AS first_second, max(second) AS last_second, min(date + to_hours(hour) + to_minutes(min) + to_seconds(second)) AS first_ts,
  max(date + to_hours(hour) + to_minutes(min) + to_seconds(second)) AS last_ts, max(event_type) AS max_stage FROM fun GROUP BY ALL)"""

CONVERSATION_SQL = """raw AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events),
conv AS (SELECT event_id, 'acct_' || lpad((user_id % 25)::VARCHAR, 4, '0') AS account_id, user_id::VARCHAR || ':' || ts::DATE::VARCHAR AS conversation_id,
  CASE event_type WHEN 'signup' THEN 'conversation_started' WHEN 'click' THEN 'message_sent' WHEN 'view' THEN 'agent_response'
    WHEN 'purchase' THEN 'resolution' WHEN 'error' THEN 'escalation' END AS event_type, ts AS event_ts,
  CASE WHEN event_type = 'view' THEN floor(value * 50)::BIGINT ELSE 0 END AS latency_ms,
  (['chat', 'voice', 'email', 'sms', 'api'])[k % 5 + 1] AS channel,
  (['agent-lg-v3', 'agent-lg-v2', 'agent-sm-v3', 'agent-voice-v1'])[k % 4 + 1] AS model, 'intent_' || (k % 12)::VARCHAR AS intent,
  user_id::VARCHAR AS user_id, k::BIGINT AS prompt_tokens, floor(value)::BIGINT AS completion_tokens, (k - 50)::DOUBLE / 50 AS sentiment,
  (event_type = 'purchase')::INT AS resolved FROM raw)"""

STAGED_SQL = """sto AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, CASE WHEN o_orderkey % 97 = 0 THEN 'NOPE' WHEN o_orderkey % 89 = 0 THEN '2026-13-40'
  ELSE o_orderdate::DATE::VARCHAR END AS raw FROM orders)"""

USERS_SQL = "us AS (SELECT c_custkey::VARCHAR AS user_id, c_mktsegment AS segment, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey)"

SLICES_SQL = "sl AS (SELECT page_type, hour, date, count(*) AS rows_written FROM imp GROUP BY ALL)"
