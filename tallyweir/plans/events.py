"""Queries over impressions: slices, staging, analyses, joins and gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.functions import scalars as sc
from tallyweir.operators import analyses as an
from tallyweir.operators import gold, rules
from tallyweir.plans.base import Registry, as_text, mean_sql, pct_sql
from tallyweir.sources.layouts import Is, Layout, Transform, read_table
from tallyweir.sources.models import IMPRESSIONS_SQL, SLICES_SQL, STAGED_SQL, USERS_SQL, funnel_events, impressions, slices, staged_orders, table, users
from tallyweir.sources.shared import scratch

FOUND = Registry()
_query = FOUND.add
_I = f"WITH {IMPRESSIONS_SQL}"

_DEPTH = mean_sql("sum(distinct_events)", "count(*)")
_REACH = "count(*) FILTER (WHERE max_stage >= '{}')"
_SUMMARY = f"""summary AS (SELECT page_type, count(*) AS impressions, count(DISTINCT user_id) AS users, {_DEPTH} AS avg_depth,
  max(distinct_events) AS max_depth, {mean_sql('sum(last_second - first_second)', 'count(*)')} AS avg_duration,
  {', '.join(f'{_REACH.format(x)} AS reaching_{x}' for x in 'def')},
  {', '.join(f"{pct_sql(_REACH.format(x), 'count(*)')} AS pct_reaching_{x}" for x in 'def')} FROM agg GROUP BY page_type)"""
_HOURLY = f"""hourly AS (SELECT date, hour, page_type, count(*) AS impressions, count(DISTINCT user_id) AS users, {_DEPTH} AS avg_depth,
  {_REACH.format('d')} AS reaching_d, {pct_sql(_REACH.format('d'), 'count(*)')} AS pct_reaching_d FROM agg GROUP BY ALL)"""
_TOP = """cnt AS (SELECT user_id, page_type, count(*) AS n FROM agg GROUP BY ALL),
top AS (SELECT user_id, page_type AS top_page, n AS top_page_count FROM cnt
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, page_type) = 1)"""
_ENGAGEMENT = f"""{_TOP}, engagement AS (SELECT user_id, impressions, pages, avg_depth, max_depth, events, first_seen, last_seen, top_page, top_page_count
  FROM (SELECT user_id, count(*) AS impressions, count(DISTINCT page_type) AS pages, {_DEPTH} AS avg_depth, max(distinct_events) AS max_depth,
    sum(event_count)::BIGINT AS events, min(first_ts)::VARCHAR AS first_seen, max(last_ts)::VARCHAR AS last_seen FROM agg GROUP BY user_id)
  JOIN top USING (user_id))"""
_FUNNEL = f"""st AS (SELECT page_type, event_type, count(DISTINCT impression_id) AS impressions FROM fun GROUP BY ALL),
tt AS (SELECT page_type, count(DISTINCT impression_id) AS total FROM fun GROUP BY ALL),
funnel AS (SELECT page_type, event_type, impressions, total, {pct_sql('impressions', 'total')} AS pct_of_total,
  {pct_sql('impressions', 'lag(impressions) OVER (PARTITION BY page_type ORDER BY event_type)')} AS pct_from_previous FROM st JOIN tt USING (page_type))"""


def _agg(s, d) -> DataFrame:
    return an.impressions_aggregated(funnel_events(s, d))


def _traffic(s, d) -> DataFrame:
    return an.hourly_traffic(_agg(s, d))


@_query("a1_impressions_aggregated", f"{_I} SELECT * REPLACE (date::VARCHAR AS date, first_ts::VARCHAR AS first_ts, last_ts::VARCHAR AS last_ts) FROM agg")
def _(s, d):
    return _agg(s, d).withColumns({c: as_text(c) for c in ("date", "first_ts", "last_ts")})


@_query(
    "a2_hour_aggregate",
    f"""{_I}, {USERS_SQL} SELECT user_id, impression_id, page_type, segment, country, count(*) AS event_count, count(DISTINCT event_type) AS distinct_events,
    min(second) AS first_second, max(second) AS last_second FROM imp LEFT JOIN us USING (user_id) WHERE date = DATE '2000-10-21' AND hour = 19 GROUP BY ALL""",
)
def _(s, d):
    enriched = an.enrich(impressions(s, d), users(s, d), "user_id", "plain")
    return an.hour_aggregate(enriched, "2000-10-21", 19, ("segment", "country"))


@_query("a3_funnel", f"{_I}, {_FUNNEL} SELECT * FROM funnel")
def _(s, d):
    return an.funnel(funnel_events(s, d))


@_query("a4_page_type_summary", f"{_I}, {_SUMMARY} SELECT * FROM summary")
def _(s, d):
    return an.page_type_summary(_agg(s, d))


@_query("a5_user_engagement", f"{_I}, {_ENGAGEMENT} SELECT * FROM engagement")
def _(s, d):
    return an.user_engagement(_agg(s, d)).withColumns({c: as_text(c) for c in ("first_seen", "last_seen")})


@_query("a6_hourly_traffic", f"{_I}, {_HOURLY} SELECT * REPLACE (date::VARCHAR AS date) FROM hourly")
def _(s, d):
    return _traffic(s, d).withColumn("date", as_text("date"))


@_query(
    "a7_lake_aggregate",
    f"""{_I}, t AS (SELECT *, date + to_hours(hour) + to_minutes(min) + to_seconds(second) AS ts FROM imp)
    SELECT impression_id, user_id, page_type, min(ts)::DATE::VARCHAR AS date, count(*) AS depth, max(event_type) AS max_stage,
    min(ts)::VARCHAR AS first_ts, max(ts)::VARCHAR AS last_ts FROM t GROUP BY impression_id, user_id, page_type""",
)
def _(s, d):
    return an.lake_aggregate(impressions(s, d)).withColumns({c: as_text(c) for c in ("date", "first_ts", "last_ts")})


@_query(
    "a13_daily_volume",
    f"""{_I} SELECT date::VARCHAR AS date, page_type, count(*) AS impressions, count(DISTINCT user_id) AS users FROM agg
    WHERE date IN (SELECT DISTINCT date FROM agg ORDER BY date DESC LIMIT 30) GROUP BY ALL""",
)
def _(s, d):
    return an.daily_volume(_agg(s, d), 30).withColumn("date", as_text("date"))


@_query(
    "a14_conversion_trend",
    f"""{_I} SELECT * FROM (SELECT date::VARCHAR AS date, count(*) AS impressions, {_REACH.format('d')} AS reaching_d,
    {pct_sql(_REACH.format('d'), 'count(*)')} AS pct_reaching_d FROM agg GROUP BY agg.date ORDER BY agg.date DESC LIMIT 14) ORDER BY date""",
)
def _(s, d):
    return an.conversion_trend(_agg(s, d), 14).withColumn("date", as_text("date"))


@_query("a23_two_phase_distinct", f"{_I} SELECT page_type, count(DISTINCT user_id) AS distinct_values FROM imp GROUP BY ALL")
def _(s, d):
    return an.two_phase_distinct(impressions(s, d), "page_type", "user_id")


@_query("a24_total_events", f"{_I} SELECT count(*) AS events, count(DISTINCT impression_id) AS impressions FROM imp")
def _(s, d):
    return impressions(s, d).agg(F.count("*").alias("events"), F.count_distinct("impression_id").alias("impressions"))


@_query("a29_mean_depth", f"{_I} SELECT {_DEPTH} AS mean_depth, count(DISTINCT user_id) AS users FROM agg")
def _(s, d):
    return _agg(s, d).agg(sc.ratio(F.sum("distinct_events"), F.count("*"), 2).alias("mean_depth"), F.count_distinct("user_id").alias("users"))


@_query("w2_top_page_per_user", f"{_I}, {_TOP} SELECT * FROM top")
def _(s, d):
    return an.top_page_per_user(_agg(s, d))


@_query(
    "w3_deduplicate_latest",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey) = 1""",
)
def _(s, d):
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return an.deduplicate_latest(rows, ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), F.asc("l_partkey"), F.asc("l_suppkey")])


@_query("f1_engagement_ranking", f"{_I}, {_ENGAGEMENT} SELECT user_id, impressions, top_page FROM engagement ORDER BY impressions DESC, user_id")
def _(s, d):
    return an.engagement_ranking(an.user_engagement(_agg(s, d))).select("user_id", "impressions", "top_page")


@_query(
    "f2_top_engaged_users",
    f"{_I} SELECT user_id, count(*) AS impressions FROM agg GROUP BY user_id HAVING count(*) >= 5 ORDER BY impressions DESC, user_id LIMIT 100",
)
def _(s, d):
    return an.top_engaged_users(_agg(s, d), 5, 100)


@_query("f3_recent_n_days", f"{_I} SELECT date::VARCHAR AS date, events FROM (SELECT date, count(*) AS events FROM imp GROUP BY ALL ORDER BY date DESC LIMIT 21) ORDER BY date")
def _(s, d):
    return gold.newest(impressions(s, d).groupBy("date").agg(F.count("*").alias("events")), "date", 21).withColumn("date", as_text("date"))


@_query("f5_funnel_slice", f"{_I}, {_FUNNEL} SELECT * FROM funnel WHERE page_type = 2")
def _(s, d):
    return gold.funnel_slice(an.funnel(funnel_events(s, d)), 2)


@_query("f6_summary_slice", f"{_I}, {_SUMMARY} SELECT * FROM summary")
def _(s, d):
    return gold.summary_slice(an.page_type_summary(_agg(s, d)), None)


@_query("f7_traffic_range", f"{_I}, {_HOURLY} SELECT * REPLACE (date::VARCHAR AS date) FROM hourly WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND page_type = 3")
def _(s, d):
    return gold.traffic_range(_traffic(s, d), "1995-01-01", "1995-12-31", 3).withColumn("date", as_text("date"))


@_query("p16_optional_filter", f"{_I}, {_HOURLY} SELECT page_type, sum(impressions)::BIGINT AS impressions FROM hourly WHERE date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' GROUP BY ALL")
def _(s, d):
    return gold.traffic_range(_traffic(s, d), "1994-01-01", "1996-12-31", None).groupBy("page_type").agg(F.sum("impressions").alias("impressions"))


@_query("s5_list_partitions", f"{_I} SELECT DISTINCT page_type, date::VARCHAR AS date, hour FROM imp ORDER BY ALL")
def _(s, d):
    return impressions(s, d).select("page_type", as_text("date"), "hour").distinct().orderBy("page_type", "date", "hour")


@_query("s6_slice_scan", f"{_I} SELECT * REPLACE (date::VARCHAR AS date) FROM imp WHERE page_type = 2 AND hour = 7")
def _(s, d):
    return gold.slice_scan(impressions(s, d), page_type=2, hour=7).withColumn("date", as_text("date"))


@_query("s7_count_slice", f"{_I} SELECT count(*) AS n_rows FROM imp WHERE page_type = 1 AND date = DATE '1997-03-04' AND hour = 12")
def _(s, d):
    return gold.slice_scan(impressions(s, d), page_type=1, date="1997-03-04", hour=12).agg(F.count("*").alias("n_rows"))


@_query(
    "s12_manifest_baseline",
    f"""{_I}, {SLICES_SQL} SELECT a.page_type, a.hour, a.date::VARCHAR AS date, a.rows_written, count(b.date) AS days_found, median(b.rows_written) AS baseline
    FROM sl a LEFT JOIN sl b ON a.page_type = b.page_type AND a.hour = b.hour AND b.date >= a.date - 7 AND b.date < a.date GROUP BY ALL""",
)
def _(s, d):
    return rules.manifest_baseline(slices(s, d)).withColumn("date", as_text("date"))


@_query(
    "s13_load_safe_cast",
    f"""WITH {STAGED_SQL} SELECT o_orderkey, (o_orderdate::DATE + to_hours((o_orderkey % 24)::INT) + to_minutes((o_custkey % 60)::INT))::VARCHAR AS event_ts
    FROM sto WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0""",
)
def _(s, d):
    at = sc.compose_ts(sc.safe_date(F.col("raw")), (F.col("o_orderkey") % 24).cast("int"), (F.col("o_custkey") % 60).cast("int"), F.lit(0))
    return staged_orders(s, d).where(sc.safe_date(F.col("raw")).isNotNull()).select("o_orderkey", at.cast("string").alias("event_ts"))


@_query("s14_filter_sink_rows", f"{_I} SELECT * REPLACE (date::VARCHAR AS date) FROM imp WHERE event_type >= 'd'")
def _(s, d):
    path = scratch(s, "deep-stages")
    return gold.filter_sink(impressions(s, d), path, "d").withColumn("date", as_text("date"))


@_query("p1_safe_date", f"WITH {STAGED_SQL} SELECT o_orderkey, CASE WHEN raw = o_orderdate::DATE::VARCHAR THEN raw END AS day FROM sto")
def _(s, d):
    return staged_orders(s, d).select("o_orderkey", sc.safe_date(F.col("raw")).cast("string").alias("day"))


@_query(
    "p3_stage_impressions",
    f"""WITH {STAGED_SQL} SELECT o_orderkey, l_linenumber, CASE WHEN raw = o_orderdate::DATE::VARCHAR THEN raw END AS date, (l_partkey % 63)::INT AS minute,
    CASE WHEN raw = o_orderdate::DATE::VARCHAR AND o_orderkey % 26 < 24 AND l_partkey % 63 < 60
      THEN (o_orderdate::DATE + to_hours((o_orderkey % 26)::INT) + to_minutes((l_partkey % 63)::INT) + to_seconds((l_suppkey % 60)::INT))::VARCHAR END AS event_ts,
    l_shipdate::VARCHAR AS loaded_at FROM sto JOIN lineitem ON l_orderkey = o_orderkey""",
)
def _(s, d):
    rows = staged_orders(s, d).join(table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    raw = rows.select("o_orderkey", "l_linenumber", F.col("raw").alias("date"), (F.col("o_orderkey") % 26).cast("int").alias("hour"), (F.col("l_partkey") % 63).cast("int").alias("min"), (F.col("l_suppkey") % 60).cast("int").alias("second"), F.col("l_shipdate").alias("loaded_at"))
    return gold.stage_impressions(raw, ["o_orderkey", "l_linenumber"]).select("o_orderkey", "l_linenumber", as_text("date"), "minute", as_text("event_ts"), as_text("loaded_at"))


@_query("p5_ts_parts", "SELECT event_id, ts::DATE::VARCHAR AS day, hour(ts)::INT AS hour, second(ts)::INT AS second FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("hour"), F.second("ts").alias("second"))


@_query("p7_parse_text_ts", f"WITH {STAGED_SQL} SELECT o_orderkey, try_strptime(raw || ' 10:20:30', '%Y-%m-%d %H:%M:%S')::VARCHAR AS ts FROM sto")
def _(s, d):
    return staged_orders(s, d).select("o_orderkey", sc.parse_text_ts(F.concat("raw", F.lit(" 10:20:30"))).cast("string").alias("ts"))


@_query("p17_tokenize", "SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS tokens FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", sc.tokens(F.col("text")).alias("tokens"))


@_query("p18_content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", sc.content_hash(F.col("text")).alias("content_hash"))


@_query(
    "p19_date_prefix_parse",
    f"""WITH {STAGED_SQL}, t AS (SELECT o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN raw || 'T10:00:00' ELSE raw END AS raw, try_cast(substr(raw, 1, 10) AS DATE) AS day FROM sto)
    SELECT o_orderstatus, count(*) FILTER (WHERE raw IS NOT NULL AND day IS NULL) AS unparsed, max(day)::VARCHAR AS newest FROM t GROUP BY ALL""",
)
def _(s, d):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat("raw", F.lit("T10:00:00"))).otherwise(F.col("raw"))
    rows = staged_orders(s, d).select("o_orderstatus", raw.alias("raw"))
    return rules.date_health(rows, "raw", ["o_orderstatus"]).withColumn("newest", as_text("newest"))


@_query("j1_enrich_broadcast", f"{_I}, {USERS_SQL} SELECT user_id, impression_id, event_type, segment, country FROM imp LEFT JOIN us USING (user_id)")
def _(s, d):
    return an.enrich(impressions(s, d), users(s, d), "user_id").select("user_id", "impression_id", "event_type", "segment", "country")


@_query("j2_enrich_salted", f"{_I}, {USERS_SQL} SELECT user_id, impression_id, event_type, segment, country FROM imp LEFT JOIN us USING (user_id)")
def _(s, d):
    return an.enrich(impressions(s, d), users(s, d), "user_id", "salted").select("user_id", "impression_id", "event_type", "segment", "country")


@_query(
    "j8_reconcile_left",
    f"""{_I}, g AS (SELECT page_type, count(*) AS impressions, count(DISTINCT user_id) AS users FROM agg GROUP BY ALL),
    o AS (SELECT page_type, count(DISTINCT impression_id) AS impressions, count(DISTINCT user_id) AS users FROM imp GROUP BY ALL)
    SELECT page_type, g.impressions AS gold_impressions, g.users AS gold_users, o.impressions AS other_impressions, o.users AS other_users,
    o.impressions - g.impressions AS delta_impressions, o.users - g.users AS delta_users FROM g LEFT JOIN o USING (page_type)""",
)
def _(s, d):
    rows = impressions(s, d).groupBy("page_type").agg(F.count_distinct("impression_id").alias("impressions"), F.count_distinct("user_id").alias("users"))
    return gold.reconcile_left(an.page_type_summary(_agg(s, d)).select("page_type", "impressions", "users"), rows, ["page_type"], ["impressions", "users"])


@_query(
    "j10_missing_periods",
    f"""{_I}, dd AS (SELECT DISTINCT page_type, hour, date FROM imp), span AS (SELECT page_type, hour, min(date) AS a, max(date) AS b FROM dd GROUP BY ALL),
    cal AS (SELECT page_type, hour, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM span)
    SELECT page_type, hour, date::VARCHAR AS date FROM cal ANTI JOIN dd USING (page_type, hour, date)""",
)
def _(s, d):
    return an.missing_periods(slices(s, d), keys=["page_type", "hour"]).withColumn("date", as_text("date"))


@_query(
    "q4_check_volume",
    f"""{_I}, {SLICES_SQL}, bb AS (SELECT a.page_type, a.hour, a.date, median(b.rows_written) AS baseline FROM sl a
      JOIN sl b ON a.page_type = b.page_type AND a.hour = b.hour AND b.date >= a.date - 7 AND b.date < a.date GROUP BY ALL)
    SELECT sl.page_type, sl.hour, sl.date::VARCHAR AS date, rows_written, baseline, CASE WHEN rows_written = 0 THEN 'anomaly'
      WHEN baseline IS NULL OR baseline = 0 THEN 'no_baseline' WHEN rows_written < baseline * 0.5 OR rows_written > baseline * 2 THEN 'anomaly' ELSE 'ok' END AS status
    FROM sl LEFT JOIN bb USING (page_type, hour, date)""",
)
def _(s, d):
    return rules.check_volume(slices(s, d)).withColumn("date", as_text("date"))


_LAYOUT = "user_id string, impression_id string, page_type int, date date, event_type string"


def _layouts(s, d):
    """Impressions until 1995 by month, later ones by page type and by buckets of users."""
    root = scratch(s, "layouts")
    rows = impressions(s, d).select("user_id", "impression_id", "page_type", "date", "event_type")
    old, new = Layout(f"{root}/old", (Transform("date", "month"),)), Layout(f"{root}/new", (Transform("page_type"), Transform("user_id", "bucket", 16)))
    old.write(rows.where("date < '1996-01-01' or date is null"))
    new.write(rows.where("date >= '1996-01-01'"))
    return old, new


@_query("l1_pruned_scan", f"{_I} SELECT impression_id, event_type FROM imp WHERE page_type = 3 AND date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'")
def _(s, d):
    """Over a root partitioned by page type: one folder of three is read."""
    return read_table(s, [_layouts(s, d)[1]], _LAYOUT, (Is("page_type", "=", 3), Is("date", ">=", "1996-01-01"), Is("date", "<=", "1996-03-31"))).select("impression_id", "event_type")


@_query("v14_two_layouts", f"{_I} SELECT user_id, impression_id, event_type FROM imp WHERE user_id IN ('7', '70', '301') AND date >= DATE '1995-10-15' AND date < DATE '1996-08-01'")
def _(s, d):
    """One filter: months of the old root, buckets of the new one."""
    where = (Is("user_id", "in", ["7", "70", "301"]), Is("date", ">=", "1995-10-15"), Is("date", "<", "1996-08-01"))
    return read_table(s, list(_layouts(s, d)), _LAYOUT, where).select("user_id", "impression_id", "event_type")


@_query(
    "u1_union_by_name",
    f"{_I} SELECT user_id, impression_id, 'deep' AS part FROM imp WHERE event_type >= 'd' UNION ALL SELECT user_id, impression_id, 'early' FROM imp WHERE event_type < 'd'",
)
def _(s, d):
    rows = impressions(s, d).select("user_id", "impression_id", "event_type")
    deep = rows.where("event_type >= 'd'").select("impression_id", "user_id", F.lit("deep").alias("part"))
    return rows.where("event_type < 'd'").select("user_id", F.lit("early").alias("part"), "impression_id").unionByName(deep)
