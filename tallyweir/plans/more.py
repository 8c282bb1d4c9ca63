"""Scalar functions, joins, monitors, versions, rollups and retrieval by name, each with its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tallyweir.functions import scalars as sc
from tallyweir.operators import analyses as an
from tallyweir.operators import monitors as mo
from tallyweir.operators import retrieval as rt
from tallyweir.operators import rules
from tallyweir.operators import versions as ve
from tallyweir.operators.joins import joined_counts
from tallyweir.plans.base import Registry
from tallyweir.plans.base import as_text as _text
from tallyweir.sources.models import CONVERSATION_SQL, IMPRESSIONS_SQL, USERS_SQL, conversation_events, funnel_events, impressions, table, users
from tallyweir.streaming import jobs

FOUND = Registry()
_query = FOUND.add

_I, _C = f"WITH {IMPRESSIONS_SQL}", f"WITH {CONVERSATION_SQL}"
_US = USERS_SQL
_DAILY = "daily AS (SELECT page_type, date, count(*) AS n FROM imp GROUP BY ALL)"


def _daily(s, d):
    return impressions(s, d).groupBy("page_type", "date").agg(F.count("*").alias("n"))


def _agg(s, d):
    return an.impressions_aggregated(funnel_events(s, d))


@_query(
    "p2_safe_event_ts",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 26 < 24 AND o_custkey % 63 < 60 AND o_orderkey % 61 < 60
      THEN (o_orderdate::DATE + to_hours((o_orderkey % 26)::INT) + to_minutes((o_custkey % 63)::INT) + to_seconds((o_orderkey % 61)::INT))::VARCHAR END AS ts FROM orders""",
)
def _(s, d):
    part = lambda c, n: (F.col(c) % n).cast("int")
    ts = sc.safe_event_ts(F.to_date("o_orderdate"), part("o_orderkey", 26), part("o_custkey", 63), part("o_orderkey", 61))
    return table(s, d, "orders").select("o_orderkey", ts.cast("string").alias("ts"))


@_query("p4_compose_ts", f"{_I} SELECT impression_id, event_type, (date + to_hours(hour) + to_minutes(min) + to_seconds(second))::VARCHAR AS ts FROM imp")
def _(s, d):
    at = sc.compose_ts(F.col("date"), F.col("hour"), F.col("min"), F.col("second"))
    return impressions(s, d).select("impression_id", "event_type", at.cast("string").alias("ts"))


@_query("p6_day_hour_trunc", "SELECT ts::DATE::VARCHAR AS day, date_trunc('hour', ts)::TIMESTAMP::VARCHAR AS hour, count(*) AS events FROM events GROUP BY ALL")
def _(s, d):
    return table(s, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), F.date_trunc("hour", "ts").cast("string").alias("hour")).agg(F.count("*").alias("events"))


@_query("p8_json_measure", "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k_sum FROM events GROUP BY ALL")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


@_query("p9_json_pack", "SELECT o_orderkey, json_object('o_custkey', o_custkey, 'o_orderstatus', o_orderstatus)::VARCHAR AS payload FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", sc.json_pack("o_custkey", "o_orderstatus").alias("payload"))


@_query(
    "p10_epoch_convert",
    """SELECT o_orderkey, (DATE '1970-01-01' + (o_custkey % 20000)::INT)::DATE::VARCHAR AS day,
    epoch_ms(o_orderkey::BIGINT * 86399000)::VARCHAR AS ts FROM orders""",
)
def _(s, d):
    day = F.date_from_unix_date((F.col("o_custkey") % 20000).cast("int"))
    ts = F.timestamp_millis(F.col("o_orderkey").cast("long") * 86399000)
    return table(s, d, "orders").select("o_orderkey", day.cast("string").alias("day"), sc.ts_text(ts).alias("ts"))


@_query("p13_stage_case", f"{_I} SELECT CASE WHEN max_stage >= 'f' THEN 'deep' WHEN max_stage >= 'd' THEN 'middle' ELSE 'shallow' END AS depth, count(*) AS impressions FROM agg GROUP BY ALL")
def _(s, d):
    depth = F.when(F.col("max_stage") >= "f", "deep").when(F.col("max_stage") >= "d", "middle").otherwise("shallow")
    return _agg(s, d).groupBy(depth.alias("depth")).agg(F.count("*").alias("impressions"))


@_query("p15_pad_key", "SELECT c_custkey, 'user_' || lpad(c_custkey::VARCHAR, 8, '0') AS user_key FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", F.concat(F.lit("user_"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("user_key"))


@_query(
    "p20_pipe_key",
    """SELECT o_orderkey, 'orders|' || coalesce(o_orderstatus, '') || '|' || coalesce(o_orderpriority, '') || '|' || coalesce(nullif(o_custkey % 5, 0)::VARCHAR, '')
    || '|' || coalesce(o_custkey::VARCHAR, '') AS finding_key FROM orders""",
)
def _(s, d):
    change = F.nullif(F.col("o_custkey") % 5, F.lit(0))
    return table(s, d, "orders").select("o_orderkey", sc.pipe_key(F.lit("orders"), F.col("o_orderstatus"), F.col("o_orderpriority"), change, F.col("o_custkey")).alias("finding_key"))


@_query(
    "p21_clamp_delta",
    f"""{_I}, {_DAILY}, p AS (SELECT *, lag(n) OVER (PARTITION BY page_type ORDER BY daily.date) AS b FROM daily)
    SELECT page_type, date::VARCHAR AS date, CASE WHEN b IS NOT NULL THEN (n - b)::DOUBLE END AS delta FROM p""",
)
def _(s, d):
    return rules.run_over_run(_daily(s, d), "page_type", "date", "n").select("page_type", _text("date"), "delta")


@_query("j3_skew_join_aggregate", f"{_I}, {_US} SELECT segment, page_type, count(*) AS events FROM imp JOIN us USING (user_id) GROUP BY ALL")
def _(s, d):
    return joined_counts(impressions(s, d), users(s, d), "user_id", ["page_type"], ["segment"])


@_query("j4_self_join_pairs", f"{_I} SELECT a.event_type AS stage, b.event_type AS later_stage, count(*) AS impressions FROM imp a JOIN imp b ON a.impression_id = b.impression_id AND a.event_type < b.event_type GROUP BY ALL")
def _(s, d):
    i = impressions(s, d).select("impression_id", "event_type")
    pairs = i.alias("a").join(i.alias("b"), (F.col("a.impression_id") == F.col("b.impression_id")) & (F.col("a.event_type") < F.col("b.event_type")))
    return pairs.groupBy(F.col("a.event_type").alias("stage"), F.col("b.event_type").alias("later_stage")).agg(F.count("*").alias("impressions"))


@_query(
    "j7_reconcile_full_outer",
    f"""{_I}, g AS (SELECT date, count(*) AS n FROM agg GROUP BY ALL), o AS (SELECT o_orderdate::DATE AS date, count(*) AS n FROM orders GROUP BY ALL)
    SELECT date::VARCHAR AS date, g.n AS gold_n, o.n AS other_n, o.n - g.n AS delta_n, coalesce(abs(o.n - g.n) > 0, true) AS mismatch FROM g FULL JOIN o USING (date)""",
)
def _(s, d):
    gold = _agg(s, d).groupBy("date").agg(F.count("*").alias("n"))
    other = table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))
    return mo.reconcile(gold, other, ["date"], ["n"]).withColumn("date", _text("date"))


@_query("j9_recent_days_join", f"{_I}, {_DAILY}, r AS (SELECT DISTINCT date FROM daily ORDER BY date DESC LIMIT 30) SELECT page_type, date::VARCHAR AS date, n FROM daily SEMI JOIN r USING (date)")
def _(s, d):
    return an.recent_days(_daily(s, d), 30).select("page_type", _text("date"), "n")


@_query("j11_vanished_entries", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1996-01-01')")
def _(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where("o_orderdate < '1996-01-01'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@_query("a26_feed_measures", "SELECT count(*) AS n_rows, round(count(*) FILTER (WHERE o_orderpriority IS NULL)::DOUBLE / nullif(count(*), 0), 4) AS null_rate, count(o_orderkey) - count(DISTINCT o_orderkey) AS duplicates, round(avg(CASE WHEN o_orderkey % 3 = 2 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS page_3_share, count(DISTINCT o_custkey) AS users FROM orders")
def _(s, d):
    share = F.avg(F.when(F.col("o_orderkey") % 3 == 2, F.lit(1.0)).otherwise(F.lit(0.0)))
    return table(s, d, "orders").agg(
        F.count("*").alias("n_rows"), F.round(F.try_divide(F.count_if(F.col("o_orderpriority").isNull()).cast("double"), F.count("*")), 4).alias("null_rate"),
        (F.count("o_orderkey") - F.count_distinct("o_orderkey")).alias("duplicates"), F.round(share, 4).alias("page_3_share"), F.count_distinct("o_custkey").alias("users"),
    )


_HISTORY = f"{_DAILY}, hist AS (SELECT *, list(n) OVER (PARTITION BY page_type ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS h FROM daily), base AS (SELECT *, list_median(h) AS baseline FROM hist)"


@_query("w4_trailing_baseline", f"{_I}, {_HISTORY} SELECT page_type, date::VARCHAR AS date, n, baseline FROM base")
def _(s, d):
    return mo.trailing(_daily(s, d), "page_type", "date", "n").select("page_type", _text("date"), "n", "baseline")


@_query("q18_monitor_ratio", f"{_I}, {_HISTORY} SELECT page_type, date::VARCHAR AS date, CASE WHEN baseline IS NULL THEN 'ok' WHEN n < baseline * 0.5 THEN 'breach' WHEN n < baseline * 0.8 THEN 'warn' ELSE 'ok' END AS status FROM base")
def _(s, d):
    return mo.trailing(_daily(s, d), "page_type", "date", "n").select("page_type", _text("date"), mo.ratio_status(F.col("n"), F.col("baseline")).alias("status"))


@_query(
    "q19_monitor_shift",
    f"""{_I}, {_HISTORY}, off AS (SELECT *, list_median([abs(x - baseline) FOR x IN h]) AS mad, list_avg([abs(x - baseline) FOR x IN h]) AS ad FROM base),
    zz AS (SELECT page_type, date::VARCHAR AS date, CASE WHEN mad > 0 THEN abs(n - baseline) / (mad * 1.4826) WHEN ad > 0 THEN abs(n - baseline) / (ad * 1.4826)
      WHEN n = baseline THEN 0.0::DOUBLE WHEN baseline IS NOT NULL THEN 'inf'::DOUBLE END AS z FROM off)
    SELECT page_type, date, round(z, 4) AS z, CASE WHEN z > 4 THEN 'breach' WHEN z > 3 THEN 'warn' ELSE 'ok' END AS status FROM zz""",
)
def _(s, d):
    rows = mo.trailing(_daily(s, d), "page_type", "date", "n").withColumn("_z", mo.robust_z(F.col("n").cast("double"), F.col("history")))
    return rows.select("page_type", _text("date"), F.round("_z", 4).alias("z"), mo.shift_status(F.col("_z")).alias("status"))


@_query("w8_run_over_run", f"{_I}, {_DAILY} SELECT page_type, date::VARCHAR AS date, n, lag(n) OVER (PARTITION BY page_type ORDER BY daily.date) AS previous, (n - lag(n) OVER (PARTITION BY page_type ORDER BY daily.date))::DOUBLE AS delta FROM daily")
def _(s, d):
    return rules.run_over_run(_daily(s, d), "page_type", "date", "n").withColumn("date", _text("date"))


@_query(
    "w9_first_seen_age",
    """SELECT o_orderkey, min(o_orderdate::DATE) OVER (PARTITION BY o_custkey)::VARCHAR AS first_seen,
    (o_orderdate::DATE - min(o_orderdate::DATE) OVER (PARTITION BY o_custkey))::INT AS age FROM orders""",
)
def _(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return mo.first_seen(rows, "o_custkey", "day").select("o_orderkey", _text("first_seen"), "age")


@_query("u2_finding_diff", "SELECT o_custkey, CASE WHEN NOT bool_or(o_orderdate < TIMESTAMP '1996-01-01') THEN 'new' WHEN NOT bool_or(o_orderdate >= TIMESTAMP '1996-01-01') THEN 'cleared' ELSE 'open' END AS state FROM orders GROUP BY o_custkey")
def _(s, d):
    o, late = table(s, d, "orders").select("o_custkey", "o_orderdate"), F.col("o_orderdate") >= "1996-01-01"
    return mo.finding_diff(o.where(late), o.where(~late), "o_custkey")


@_query("u5_recall_overlap", "WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), f AS (SELECT DISTINCT l_orderkey, l_partkey, 1 AS hit FROM lineitem WHERE l_linenumber <= 3) SELECT l_orderkey, coalesce(sum(hit), 0)::BIGINT AS hits, count(*) AS expected, round(coalesce(sum(hit), 0) / count(*), 4) AS recall FROM e LEFT JOIN f USING (l_orderkey, l_partkey) GROUP BY ALL")
def _(s, d):
    x = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return rt.recall_overlap(x.where("l_linenumber <= 3"), x, "l_orderkey", "l_partkey").withColumn("recall", F.round("recall", 4))


@_query("q2_reconcile_counts", f"{_I}, {_DAILY} SELECT page_type, date::VARCHAR AS date, n, abs(8 - n) <= 8 * 0.25 AS holds FROM daily")
def _(s, d):
    return _daily(s, d).select("page_type", _text("date"), "n", mo.count_drift(F.lit(8), F.col("n"), 0.25).alias("holds"))


_ARRIVED = """n AS (SELECT l_shipdate::DATE AS day, count(*) AS n_rows FROM lineitem GROUP BY ALL),
c AS (SELECT unnest(generate_series(min(day), greatest(max(day), DATE '2001-11-30'), INTERVAL 1 DAY))::DATE AS day FROM n)"""


@_query("q23_arrival_lag", "SELECT o_orderstatus, (DATE '2001-08-05' - max(o_orderdate::DATE))::INT AS lag_days, DATE '2001-08-05' - max(o_orderdate::DATE) > 4 AS late FROM orders GROUP BY ALL")
def _(s, d):
    return mo.arrival_lag(table(s, d, "orders").withColumn("day", F.to_date("o_orderdate")), "day", "2001-08-05", 4, ["o_orderstatus"])


@_query("q24_arrival_gap", f"WITH {_ARRIVED} SELECT day::VARCHAR AS day FROM c ANTI JOIN n USING (day)")
def _(s, d):
    days = mo.arrivals(table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("at")), "at", 2, "2001-11-30")
    return days.where("status = 'gap'").select(_text("day"))


@_query("q25_arrival_partial", f"WITH {_ARRIVED} SELECT day::VARCHAR AS day, coalesce(n_rows, 0) AS n_rows, CASE WHEN n_rows IS NULL THEN 'gap' WHEN n_rows < 20 THEN 'partial' ELSE 'ok' END AS status FROM c LEFT JOIN n USING (day)")
def _(s, d):
    return mo.arrivals(table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("at")), "at", 20, "2001-11-30").withColumn("day", _text("day"))


_CHANGES = "ch AS (SELECT user_id, event_id, event_type FROM events), vv AS (SELECT user_id, event_type, event_id AS valid_from, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to FROM ch)"


def _versions(s, d):
    return ve.versions_of(table(s, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@_query("v4_read_as_of_version", f"WITH {_CHANGES} SELECT * FROM vv WHERE valid_from <= 500 AND (valid_to IS NULL OR valid_to > 500)")
def _(s, d):
    return ve.as_of(_versions(s, d), 500)


_BACK = 1 << 60


@_query("v6_rollback", f"WITH {_CHANGES} SELECT user_id, event_type, valid_from, coalesce(valid_to, {_BACK}) AS valid_to FROM vv UNION ALL SELECT user_id, event_type, {_BACK}, NULL FROM vv WHERE valid_from <= 500 AND (valid_to IS NULL OR valid_to > 500)")
def _(s, d):
    return ve.rolled_back(_versions(s, d), 500, _BACK)


_SNAPSHOTS = """sn AS (SELECT ts::DATE AS day, max(event_id) AS version, max(ts) AS committed_at, count(*) AS added FROM events GROUP BY ALL)"""


def _snapshots(s, d):
    per = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.max("event_id").alias("version"), F.max("ts").alias("committed_at"), F.count("*").alias("added"))
    return per.withColumn("table_name", F.lit("events"))


@_query(
    "v5_read_as_of_timestamp",
    f"""WITH {_CHANGES}, {_SNAPSHOTS}, aa AS (SELECT max(version) AS v FROM sn WHERE committed_at <= TIMESTAMP '2024-01-15 00:00:00')
    SELECT user_id, event_type, valid_from, valid_to FROM vv, aa WHERE valid_from <= v AND (valid_to IS NULL OR valid_to > v)""",
)
def _(s, d):
    return ve.as_of_time(_versions(s, d), _snapshots(s, d), "2024-01-15 00:00:00")


@_query(
    "v9_expire_versions",
    f"""WITH {_CHANGES}, {_SNAPSHOTS}, keep AS (SELECT min(version) AS v FROM (SELECT version FROM sn ORDER BY version DESC LIMIT 5))
    SELECT user_id, event_type, valid_from, valid_to FROM vv, keep WHERE valid_to IS NULL OR valid_to > least(v, 800)""",
)
def _(s, d):
    return ve.expired(_versions(s, d), _snapshots(s, d), 800)


_SIDES = """o_orderkey, o_orderstatus AS h FROM orders WHERE o_orderdate {} TIMESTAMP '{}'"""


@_query(
    "v18_sync_by_hash",
    f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'x' ELSE o_orderstatus END AS h FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
    u AS (SELECT {_SIDES.format('>=', '1996-06-01')})
    SELECT o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'inserted' WHEN u.o_orderkey IS NULL THEN 'deleted' WHEN t.h = u.h THEN 'unchanged' ELSE 'updated' END AS action
    FROM (SELECT o_orderkey FROM t UNION SELECT o_orderkey FROM u) LEFT JOIN t USING (o_orderkey) LEFT JOIN u USING (o_orderkey)""",
)
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", F.col("o_orderstatus").alias("h"))
    old = o.where("o_orderdate < '2000-01-01'").withColumn("h", F.when(F.col("o_orderpriority") == "1-URGENT", "x").otherwise(F.col("h")))
    return ve.sync_by_hash(old, o.where("o_orderdate >= '1996-06-01'"), "o_orderkey", "h")


_DAYS = "SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM orders WHERE o_orderdate {} TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


@_query(
    "v1_merge_upsert",
    f"""WITH t AS ({_DAYS.format('<')}), u AS ({_DAYS.format('>=')})
    SELECT o_custkey, o_orderkey, o_orderstatus FROM u UNION ALL SELECT o_custkey, o_orderkey, o_orderstatus FROM t ANTI JOIN u USING (o_custkey)""",
)
def _(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    latest = lambda rows: an.deduplicate_latest(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")
    return rules.merge_upsert(latest(o.where("o_orderdate < '1998-01-01'")), latest(o.where("o_orderdate >= '1998-01-01'")), ["o_custkey"])


@_query("v2_delete_where", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL")
def _(s, d):
    return rules.delete_where(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "F")


@_query("t2_minute_rollup", f"{_C} SELECT date_trunc('minute', event_ts)::TIMESTAMP::VARCHAR AS window_start, account_id, event_type, count(*) AS events, count(*) FILTER (WHERE event_type = 'conversation_started') AS started, count(*) FILTER (WHERE event_type = 'escalation') AS escalated, count(*) FILTER (WHERE event_type = 'resolution') AS resolved, coalesce(round(avg(latency_ms) FILTER (WHERE event_type = 'agent_response'), 4), 0.0)::DOUBLE AS avg_latency, coalesce(max(latency_ms) FILTER (WHERE event_type = 'agent_response'), 0) AS max_latency FROM conv GROUP BY ALL")
def _(s, d):
    return jobs.minute_rollup(conversation_events(s, d)).drop("window_end").withColumn("window_start", _text("window_start"))


_CDC = "cdc AS (SELECT (user_id % 3 + 1)::INT AS page_type, user_id::VARCHAR AS impression_id, ts AS event_ts, event_id, CASE WHEN event_type = 'error' THEN 'd' ELSE 'u' END AS op FROM events)"


def _cdc(s, d):
    return table(s, d, "events").select((F.col("user_id") % 3 + 1).cast("int").alias("page_type"), F.col("user_id").cast("string").alias("impression_id"), F.col("ts").alias("event_ts"), "event_id", F.when(F.col("event_type") == "error", "d").otherwise("u").alias("op"))


@_query("t3_cdc_minute_counts", f"WITH {_CDC} SELECT page_type, date_trunc('minute', event_ts)::TIMESTAMP::VARCHAR AS window_start, count(*) AS events, count(DISTINCT impression_id) AS impressions FROM cdc WHERE op <> 'd' GROUP BY ALL")
def _(s, d):
    return jobs.cdc_minute_counts(_cdc(s, d).withColumn("event_ts", F.col("event_ts").cast("timestamp"))).drop("window_end").withColumn("window_start", _text("window_start"))


@_query("t13_cdc_materialise", f"WITH {_CDC}, ll AS (SELECT * FROM cdc QUALIFY row_number() OVER (PARTITION BY impression_id ORDER BY event_ts DESC, event_id DESC) = 1) SELECT page_type, impression_id, event_id FROM ll WHERE op <> 'd'")
def _(s, d):
    return jobs.current_rows(_cdc(s, d), ["impression_id"], ["event_ts", "event_id"]).drop("event_ts")


_TERMS = "tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS t FROM documents), tf AS (SELECT doc_id, len(t)::BIGINT AS length, unnest(t) AS term FROM tk), tt AS (SELECT doc_id, length, term, count(*) AS tf FROM tf GROUP BY ALL)"


def _terms(s, d):
    return rt.terms(table(s, d, "documents"), "doc_id", "text")


@_query("r2_bm25_fit", f"WITH {_TERMS} SELECT term, count(*) AS df, (SELECT count(*) FROM documents) AS n_texts, (SELECT round(avg(coalesce(len(t), 0)), 4) FROM tk) AS average_length FROM tt GROUP BY ALL")
def _(s, d):
    lengths = rt.corpus_lengths(table(s, d, "documents"), "text")
    return rt.bm25_fit(_terms(s, d), "doc_id").withColumns({c: lengths.select(c).scalar() for c in lengths.columns})


@_query("r13_index_stats", "SELECT label, count(*) AS vectors FROM embeddings GROUP BY ALL")
def _(s, d):
    return rt.vectors_per_tenant(table(s, d, "embeddings"), "label")


_RATE = "SELECT event_id, CASE WHEN user_id % 7 <> 0 THEN round(value / (user_id % 7), 4) END AS rate FROM events"


def _rated(s, d):
    return table(s, d, "events").select("event_id", "value", (F.col("user_id") % 7).alias("n"))


@_query("x1_udf_python", _RATE)
def _(s, d):
    rate = F.udf(lambda v, n: v / n if n else None, "double", useArrow=True)
    return _rated(s, d).select("event_id", F.round(rate("value", "n"), 4).alias("rate"))


@_query("x2_udf_pandas", _RATE)
def _(s, d):
    @F.pandas_udf("double")
    def rate(v: pd.Series, n: pd.Series) -> pd.Series:
        return v / n.where(n != 0)

    return _rated(s, d).select("event_id", F.round(rate("value", "n"), 4).alias("rate"))


@_query("x3_udf_native", _RATE)
def _(s, d):
    return _rated(s, d).select("event_id", F.round(F.try_divide("value", "n"), 4).alias("rate"))
