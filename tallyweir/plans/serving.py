"""Queries over conversation events: dashboards, rollup states and what is served from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweir.operators import dashboards as db
from tallyweir.plans.base import Registry, as_text
from tallyweir.sources.layouts import Layout, Transform, expire, read_table
from tallyweir.sources.models import CONVERSATION_SQL, conversation_events, naive_conversation_events, table
from tallyweir.sources.shared import scratch
from tallyweir.streaming import jobs

FOUND = Registry()
_query = FOUND.add
_C = f"WITH {CONVERSATION_SQL}"

_COUNT = "count(*) FILTER (WHERE event_type = '{}')".format
_RESPONSE = "FILTER (WHERE event_type = 'agent_response')"
_RATE = "round(({})::DOUBLE / nullif({}, 0), 4)".format
#: The sums of a state.
_STATE = f"""count(*) AS events, {_COUNT('conversation_started')} AS started, {_COUNT('resolution')} AS resolved, {_COUNT('escalation')} AS escalated,
  {_COUNT('agent_response')} AS responses, count(*) FILTER (WHERE event_type = 'agent_response' AND latency_ms > 5000) AS slow,
  coalesce(sum(latency_ms) {_RESPONSE}, 0)::BIGINT AS latency_sum, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens,
  coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens, round(coalesce(sum(sentiment::DECIMAL(20,4)), 0)::DOUBLE, 4) AS sentiment_sum,
  count(sentiment) AS sentiment_n"""
_DASHBOARD = f"""SELECT event_ts::DATE::VARCHAR AS day, count(*) AS events, {_COUNT('conversation_started')} AS started, {_COUNT('resolution')} AS resolved,
  {_COUNT('escalation')} AS escalated, {_RATE(_COUNT('escalation'), _COUNT('conversation_started'))} AS escalation_rate,
  round(quantile_cont(latency_ms, 0.95) {_RESPONSE}, 4) AS p95_latency FROM conv WHERE account_id = 'acct_0003' GROUP BY ALL"""
_HEALTH = f"""SELECT event_ts::DATE::VARCHAR AS day, {_COUNT('conversation_started')} AS started, {_COUNT('escalation')} AS escalated,
  round(quantile_cont(latency_ms, 0.99) {_RESPONSE}, 4) AS p99_latency FROM conv GROUP BY ALL"""
_SLOW = """SELECT model, channel, count(*) AS slow, round(quantile_cont(latency_ms, 0.99), 4) AS p99_latency FROM conv
  WHERE event_type = 'agent_response' AND latency_ms > 5000 GROUP BY ALL"""
_LOOKUP = "SELECT event_id, event_ts::VARCHAR AS event_ts, event_type, latency_ms FROM conv WHERE conversation_id = '7:2024-01-05'"


def _typed(s, d):
    return db.typed(naive_conversation_events(s, d))


def _daily(s, d):
    return db.daily_state(conversation_events(s, d))


def _hourly(s, d):
    return db.hourly_state(conversation_events(s, d))


def _sums(states):
    return states.drop("latency_sketch").withColumn("sentiment_sum", F.round(F.col("sentiment_sum").cast("double"), 4))


@_query("a8_tenant_dashboard", f"{_C} {_DASHBOARD}")
def _(s, d):
    return db.tenant_dashboard(conversation_events(s, d), "acct_0003", "2000-01-01", "2100-01-01").withColumn("day", as_text("day"))


@_query("a9_platform_health", f"{_C} {_HEALTH}")
def _(s, d):
    return db.platform_health(conversation_events(s, d)).withColumn("day", as_text("day"))


@_query("a10_slow_responses", f"{_C} {_SLOW} ORDER BY slow DESC, model, channel")
def _(s, d):
    return db.slow_responses(conversation_events(s, d)).orderBy(F.desc("slow"), "model", "channel")


@_query(
    "a11_top_intents",
    f"""{_C} SELECT intent, count(*) AS events, {_COUNT('escalation')} AS escalations FROM conv WHERE account_id = 'acct_0003'
    AND event_ts >= TIMESTAMP '2024-01-05' AND event_ts < TIMESTAMP '2024-01-25' GROUP BY ALL ORDER BY events DESC, intent LIMIT 20""",
)
def _(s, d):
    return db.top_intents(conversation_events(s, d), "acct_0003", "2024-01-05", "2024-01-25")


@_query("a12_naive_dashboard", f"{_C} {_DASHBOARD}")
def _(s, d):
    return db.tenant_dashboard(_typed(s, d), "acct_0003", "2000-01-01", "2100-01-01").withColumn("day", as_text("day"))


@_query("a12_naive_health", f"{_C} {_HEALTH}")
def _(s, d):
    return db.platform_health(_typed(s, d)).withColumn("day", as_text("day"))


@_query("a12_naive_slow_responses", f"{_C} {_SLOW}")
def _(s, d):
    return db.slow_responses(_typed(s, d))


@_query("a12_naive_lookup", f"{_C} {_LOOKUP.replace('event_id,', 'event_id::VARCHAR AS event_id,')}")
def _(s, d):
    return db.conversation_lookup(_typed(s, d), "7:2024-01-05").withColumn("event_ts", as_text("event_ts"))


@_query("a15_rollup_daily_sums", f"{_C} SELECT account_id, event_ts::DATE::VARCHAR AS day, {_STATE} FROM conv GROUP BY ALL")
def _(s, d):
    return _sums(_daily(s, d)).withColumn("day", as_text("day"))


@_query("a16_rollup_hourly_sums", f"{_C} SELECT account_id, date_trunc('hour', event_ts)::TIMESTAMP::VARCHAR AS hour, model, channel, {_STATE} FROM conv WHERE event_type = 'agent_response' GROUP BY ALL")
def _(s, d):
    return _sums(_hourly(s, d)).withColumn("hour", as_text("hour"))


@_query("a17_rollup_platform_sums", f"{_C} SELECT event_ts::DATE::VARCHAR AS day, {_STATE} FROM conv GROUP BY ALL")
def _(s, d):
    return _sums(db.platform_state(conversation_events(s, d))).withColumn("day", as_text("day"))


@_query(
    "a18_merge_rollup_states",
    f"""{_C}, st AS (SELECT account_id, {_STATE} FROM conv GROUP BY ALL)
    SELECT *, {_RATE('latency_sum', 'responses')} AS mean_latency, {_RATE('escalated', 'started')} AS escalation_rate, {_RATE('resolved', 'started')} AS resolution_rate,
    {_RATE('slow', 'responses')} AS slow_rate FROM st""",
)
def _(s, d):
    merged = db.merge_states(_daily(s, d), ["account_id"])
    return _sums(merged).drop("mean_sentiment", *db.QUANTILES)



@_query(
    "a18_merged_quantiles_near_exact",
    f"{_C} SELECT account_id, true AS p50_near, true AS p95_near, true AS p99_near FROM conv WHERE event_type = 'agent_response' GROUP BY ALL",
)
def _(s, d):
    """Is the rank of each quantile of the merged sketches within 5 % of what it stands for?"""
    merged = db.merge_states(_daily(s, d), ["account_id"]).select("account_id", *db.QUANTILES)
    rows = conversation_events(s, d).where("event_type = 'agent_response'").join(merged, "account_id")
    share = lambda c: F.count_if(c) / F.count("*")
    near = lambda q, p: (share(F.col("latency_ms") <= F.col(q)) >= p - 0.05) & (share(F.col("latency_ms") < F.col(q)) <= p + 0.05)
    return rows.groupBy("account_id").agg(*[near(q, p).alias(f"{q}_near") for q, p in zip(db.QUANTILES, (0.5, 0.95, 0.99), strict=True)])


@_query(
    "a19_account_summary",
    f"""{_C}, st AS (SELECT account_id, {_STATE} FROM conv WHERE account_id = 'acct_0003' GROUP BY ALL)
    SELECT account_id, events, started, resolved, escalated, {_RATE('escalated', 'started')} AS escalation_rate, {_RATE('resolved', 'started')} AS resolution_rate FROM st""",
)
def _(s, d):
    return db.account_summary(_daily(s, d), "acct_0003").drop("mean_sentiment", *db.QUANTILES)


@_query("a19_account_summary_quantiles")
def _(s, d):
    return db.account_summary(_daily(s, d), "acct_0003")


@_query(
    "a20_agent_latency",
    f"""{_C}, st AS (SELECT model, channel, {_STATE} FROM conv WHERE event_type = 'agent_response' GROUP BY ALL)
    SELECT model, channel, responses, {_RATE('slow', 'responses')} AS slow_rate, prompt_tokens + completion_tokens AS total_tokens FROM st""",
)
def _(s, d):
    return db.agent_latency(_hourly(s, d)).drop(*db.QUANTILES)


@_query("a20_agent_latency_quantiles")
def _(s, d):
    return db.agent_latency(_hourly(s, d))


@_query("a21_hourly_volume", f"{_C} SELECT date_trunc('hour', event_ts)::TIMESTAMP::VARCHAR AS hour, count(*) AS responses FROM conv WHERE event_type = 'agent_response' AND account_id = 'acct_0003' GROUP BY ALL")
def _(s, d):
    return db.hourly_volume(_hourly(s, d), "acct_0003").drop("p95").withColumn("hour", as_text("hour"))


_EXACT = "round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(quantile_cont(latency_ms, 0.99), 4) AS p99 FROM conv WHERE event_type = 'agent_response'"


def _exact(rows, keys):
    return db.exact_served(rows, keys).select(*keys, *[F.round(q, 4).alias(q) for q in db.QUANTILES])


@_query("a19_account_summary_exact", f"{_C} SELECT account_id, {_EXACT} AND account_id = 'acct_0003' GROUP BY ALL")
def _(s, d):
    return _exact(conversation_events(s, d).where("account_id = 'acct_0003'"), ["account_id"])


@_query("a20_agent_latency_exact", f"{_C} SELECT model, channel, {_EXACT} GROUP BY ALL")
def _(s, d):
    return _exact(conversation_events(s, d), ["model", "channel"])


@_query("a21_hourly_volume_exact", f"{_C} SELECT date_trunc('hour', event_ts)::TIMESTAMP::VARCHAR AS hour, {_EXACT} AND account_id = 'acct_0003' GROUP BY ALL")
def _(s, d):
    rows = conversation_events(s, d).where("account_id = 'acct_0003'").withColumn("hour", F.date_trunc("hour", "event_ts").cast("timestamp_ntz"))
    return _exact(rows, ["hour"]).withColumn("hour", as_text("hour"))


@_query("a22_additive_state_sum", f"{_C} SELECT account_id, {_STATE} FROM (FROM conv UNION ALL FROM conv) GROUP BY ALL")
def _(s, d):
    states = db.rollup_state(conversation_events(s, d), ["account_id"])
    return _sums(db.collapsed(states.unionByName(states), ["account_id"]))


@_query("f4_conversation_lookup", f"{_C} {_LOOKUP}")
def _(s, d):
    return db.conversation_lookup(conversation_events(s, d), "7:2024-01-05").withColumn("event_ts", as_text("event_ts"))


@_query(
    "f4_conversation_page",
    f"""{_C} SELECT event_id, event_ts::VARCHAR AS event_ts, event_type, latency_ms, channel, model, intent, sentiment, resolved FROM conv
    WHERE conversation_id = '7:2024-01-05' ORDER BY conv.event_ts, event_type, event_id LIMIT 500""",
)
def _(s, d):
    return db.conversation_page(conversation_events(s, d), "7:2024-01-05").withColumn("event_ts", as_text("event_ts"))


@_query(
    "t6_dedup_table",
    f"""{_C}, twice AS (SELECT account_id, conversation_id, event_ts, event_type, event_id FROM (FROM conv UNION ALL FROM conv))
    SELECT account_id, event_type, count(*) AS events FROM (SELECT DISTINCT * FROM twice) GROUP BY ALL""",
)
def _(s, d):
    events = conversation_events(s, d).select("account_id", "conversation_id", "event_ts", "event_type", "event_id")
    return jobs.dedup_table(events.unionByName(events), events.columns).groupBy("account_id", "event_type").agg(F.count("*").alias("events"))


@_query("t8_backfill_rollup", f"{_C} SELECT account_id, event_ts::DATE::VARCHAR AS day, {_STATE} FROM conv GROUP BY ALL")
def _(s, d):
    """States of days before the view's first one come from the same aggregation and are merged with the view's."""
    events, first = conversation_events(s, d), F.lit("2024-01-15").cast("timestamp_ntz")
    view = db.daily_state(events.where(F.col("event_ts") >= first))
    return _sums(db.collapsed(jobs.backfilled(view, events.where(F.col("event_ts") < first), db.daily_state), ["account_id", "day"])).withColumn("day", as_text("day"))


@_query(
    "t9_retention",
    """SELECT o_orderdate::DATE::VARCHAR AS day, count(*) AS orders FROM orders WHERE o_orderdate::DATE > DATE '2001-08-02' - 730 GROUP BY ALL""",
)
def _(s, d):
    """Folders of whole months go, the month of the edge is written anew."""
    layout, fields = Layout(scratch(s, "retention"), (Transform("day", "month"),)), "o_orderkey long, day date"
    layout.write(table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.to_date("o_orderdate").alias("day")))
    expire(s, layout, fields, "day", "1999-08-04")
    rows = read_table(s, [layout], fields).where("day is not null").withColumnRenamed("day", "o_orderdate")
    return rows.groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.count("*").alias("orders"))
