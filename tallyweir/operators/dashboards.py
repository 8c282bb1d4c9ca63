"""Dashboards over conversation events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.scalars import ratio
from tallyweir.operators.quantiles import exact_quantiles, same_keys

SLOW_MS = 5000


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _with_quantile(per: DataFrame, events: DataFrame, keys: list[str], name: str, p: float) -> DataFrame:
    """``per`` with an exact quantile of the latencies of responses, by counting passes instead of a list a group."""
    of = exact_quantiles(events.select(*keys, F.when(_is("agent_response"), F.col("latency_ms")).alias("_ms")), keys, "_ms", {"_q": p})
    others = [f"_of_{k}" for k in keys]
    of = of.withColumnsRenamed(dict(zip(keys, others, strict=True)))
    return per.join(of, same_keys(keys, others), "left").select(*per.columns, F.round("_q", 4).alias(name))


def _inside(account: str, start: str, end: str) -> Column:
    at = F.col("event_ts")
    return (F.col("account_id") == account) & (at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))


def tenant_dashboard(events: DataFrame, account: str, start: str, end: str) -> DataFrame:
    """Per day of [start, end) for one account."""
    rows = events.where(_inside(account, start, end)).withColumn("day", F.to_date("event_ts"))
    started, escalated = F.count_if(_is("conversation_started")), F.count_if(_is("escalation"))
    per = rows.groupBy("day").agg(
        F.count("*").alias("events"), started.alias("started"), F.count_if(_is("resolution")).alias("resolved"), escalated.alias("escalated"),
        F.round(F.try_divide(escalated.cast("decimal(20,6)"), started.cast("decimal(20,0)")), 4).cast("double").alias("escalation_rate"),
    )
    return _with_quantile(per, rows, ["day"], "p95_latency", 0.95)


def platform_health(events: DataFrame) -> DataFrame:
    rows = events.withColumn("day", F.to_date("event_ts"))
    per = rows.groupBy("day").agg(F.count_if(_is("conversation_started")).alias("started"), F.count_if(_is("escalation")).alias("escalated"))
    return _with_quantile(per, rows, ["day"], "p99_latency", 0.99)


def slow_responses(events: DataFrame) -> DataFrame:
    rows = events.where(_is("agent_response") & (F.col("latency_ms") > SLOW_MS))
    return _with_quantile(rows.groupBy("model", "channel").agg(F.count("*").alias("slow")), rows, ["model", "channel"], "p99_latency", 0.99)


def top_intents(events: DataFrame, account: str, start: str, end: str, n: int = 20) -> DataFrame:
    per = events.where(_inside(account, start, end)).groupBy("intent").agg(F.count("*").alias("events"), F.count_if(_is("escalation")).alias("escalations"))
    return per.orderBy(F.desc("events"), "intent").limit(n)


LOOKUP, SERVED = ("event_id", "event_ts", "event_type", "latency_ms"), ("channel", "model", "intent", "sentiment", "resolved")


def conversation_lookup(events: DataFrame, conversation: str) -> DataFrame:
    """All events of one conversation by time and type."""
    return events.where(F.col("conversation_id") == conversation).orderBy("event_ts", "event_type", "event_id").select(*LOOKUP)


def conversation_page(events: DataFrame, conversation: str, n: int = 500) -> DataFrame:
    """The form that is served: more columns, at most ``n`` rows."""
    return events.where(F.col("conversation_id") == conversation).orderBy("event_ts", "event_type", "event_id").select(*LOOKUP, *SERVED).limit(n)


def typed(naive: DataFrame) -> DataFrame:
    """All-text events with a JSON ``payload`` as typed ones; what does not parse is null."""
    fields = "latency_ms bigint, prompt_tokens bigint, completion_tokens bigint, sentiment double, resolved int"
    rows = naive.withColumn("_m", F.from_json("payload", fields)).withColumn("event_ts", F.expr("try_cast(event_ts as timestamp_ntz)"))
    return rows.select(*[c for c in naive.columns if c != "payload"], "_m.*")


_SUMS = ("events", "started", "resolved", "escalated", "responses", "slow", "latency_sum", "prompt_tokens", "completion_tokens", "sentiment_n")


def rollup_state(events: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Mergeable partial aggregates: sums, an average as its two parts, a quantile sketch of response latencies."""
    response = F.when(_is("agent_response"), F.col("latency_ms"))
    return events.groupBy(*keys).agg(
        F.count("*").alias("events"),
        F.count_if(_is("conversation_started")).alias("started"),
        F.count_if(_is("resolution")).alias("resolved"),
        F.count_if(_is("escalation")).alias("escalated"),
        F.count(response).alias("responses"),
        F.count_if(response > SLOW_MS).alias("slow"),
        F.coalesce(F.sum(response), F.lit(0)).alias("latency_sum"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum(F.col("sentiment").cast("decimal(20,4)")), F.lit(0)).alias("sentiment_sum"),
        F.count("sentiment").alias("sentiment_n"),
        F.kll_sketch_agg_bigint(response).alias("latency_sketch"),
    )


def daily_state(events: DataFrame) -> DataFrame:
    return rollup_state(events, ["account_id", F.to_date("event_ts").alias("day")])


def hourly_state(events: DataFrame) -> DataFrame:
    """Responses only."""
    return rollup_state(events.where(_is("agent_response")), ["account_id", F.date_trunc("hour", "event_ts").cast("timestamp_ntz").alias("hour"), "model", "channel"])


def platform_state(events: DataFrame) -> DataFrame:
    return rollup_state(events, [F.to_date("event_ts").alias("day")])


def collapsed(states: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal key become one: sums of sums, sketches merged. Merging again changes nothing."""
    sums = [F.sum(c).alias(c) for c in (*_SUMS, "sentiment_sum")]
    return states.groupBy(*keys).agg(*sums, F.kll_merge_agg_bigint("latency_sketch").alias("latency_sketch"))


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """Collapsed states with their averages, rates and quantiles (null without responses)."""
    at = lambda p: F.when(F.col("responses") > 0, F.kll_sketch_get_quantile_bigint("latency_sketch", F.lit(p)))
    return collapsed(states, keys).withColumns(
        {
            "mean_latency": ratio(F.col("latency_sum"), F.col("responses"), 4),
            "mean_sentiment": ratio(F.col("sentiment_sum"), F.col("sentiment_n"), 4),
            "escalation_rate": ratio(F.col("escalated"), F.col("started"), 4),
            "resolution_rate": ratio(F.col("resolved"), F.col("started"), 4),
            "slow_rate": ratio(F.col("slow"), F.col("responses"), 4),
            **{f"p{round(p * 100)}": at(p) for p in (0.5, 0.95, 0.99)},
        }
    )


QUANTILES = ("p50", "p95", "p99")


def account_summary(daily: DataFrame, account: str) -> DataFrame:
    """One account over all days of its daily states."""
    columns = ("events", "started", "resolved", "escalated", "escalation_rate", "resolution_rate", "mean_sentiment", *QUANTILES)
    return merge_states(daily.where(F.col("account_id") == account), ["account_id"]).select("account_id", *columns)


def agent_latency(hourly: DataFrame) -> DataFrame:
    """By model and channel over the hourly states."""
    out = merge_states(hourly, ["model", "channel"])
    return out.select("model", "channel", "responses", "slow_rate", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), *QUANTILES)


def hourly_volume(hourly: DataFrame, account: str) -> DataFrame:
    return merge_states(hourly.where(F.col("account_id") == account), ["hour"]).select("hour", "responses", "p95")


def exact_served(events: DataFrame, keys: list[str]) -> DataFrame:
    """The exact ``QUANTILES`` of response latencies by key, against which those of merged sketches are held."""
    responses = events.where(_is("agent_response"))
    return exact_quantiles(responses, keys, "latency_ms", {f"p{round(p * 100)}": p for p in (0.5, 0.95, 0.99)})


def retained(rows: DataFrame, day: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days up to ``as_of``; raw rows are kept 90, minute rows 14, aggregates 730."""
    return rows.where(F.to_date(day) > F.date_sub(F.lit(as_of).cast("date"), days))
