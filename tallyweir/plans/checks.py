"""Queries over contracts, freshness, monitors, drift and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweir.operators import analyses as an
from tallyweir.operators import contracts as co
from tallyweir.operators import monitors as mo
from tallyweir.operators import rules
from tallyweir.operators import versions as ve
from tallyweir.plans.base import Registry, as_text
from tallyweir.sources.models import IMPRESSIONS_SQL, SLICES_SQL, STAGED_SQL, funnel_events, impressions, slices, staged_orders, table

FOUND = Registry()
_query = FOUND.add
_I = f"WITH {IMPRESSIONS_SQL}"

_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")


def _rule_sql(check: str, column: str, metric: str, holds: str, bad: str = "error") -> str:
    return f"SELECT '{check}' AS \"check\", '{column}' AS \"column\", ({metric})::BIGINT AS metric, CASE WHEN {holds} THEN 'ok' ELSE '{bad}' END AS status FROM rows_of"


def _results_sql(name: str, source: str, *parts: str) -> str:
    return f"WITH {source} SELECT '{name}' AS table_name, * FROM ({' UNION ALL '.join(parts)})"


_ORDERS = f"{STAGED_SQL}, rows_of AS (SELECT o.*, raw FROM orders o JOIN sto USING (o_orderkey))"


def _orders(s, d):
    return table(s, d, "orders").join(staged_orders(s, d).select("o_orderkey", "raw"), "o_orderkey")


@_query(
    "q9_expect_not_null",
    _results_sql(
        "orders", _ORDERS,
        _rule_sql("not_null", "o_orderkey", "count(*) FILTER (WHERE o_orderkey IS NULL)", "count(*) FILTER (WHERE o_orderkey IS NULL) = 0"),
        "SELECT 'not_null', 'o_absent', NULL::BIGINT, 'error'",
    ),
)
def _(s, d):
    return co.contract_results(_orders(s, d), "orders", [co.Rule("not_null", "o_orderkey"), co.Rule("not_null", "o_absent")])


@_query(
    "q10_expect_unique",
    _results_sql(
        "orders", _ORDERS,
        _rule_sql("unique", "o_orderkey", "count(o_orderkey) - count(DISTINCT o_orderkey)", "count(o_orderkey) = count(DISTINCT o_orderkey)"),
        _rule_sql("unique", "o_custkey", "count(o_custkey) - count(DISTINCT o_custkey)", "count(o_custkey) = count(DISTINCT o_custkey)"),
    ),
)
def _(s, d):
    return co.contract_results(_orders(s, d), "orders", [co.Rule("unique", "o_orderkey"), co.Rule("unique", "o_custkey")])


@_query(
    "q11_expect_accepted_values",
    _results_sql(
        "orders", _ORDERS,
        _rule_sql("accepted_values", "o_orderpriority", f"count(*) FILTER (WHERE o_orderpriority NOT IN {_PRIORITIES})", f"count(*) FILTER (WHERE o_orderpriority NOT IN {_PRIORITIES}) = 0", "warn"),
    ),
)
def _(s, d):
    return co.contract_results(_orders(s, d), "orders", [co.Rule("accepted_values", "o_orderpriority", _PRIORITIES, severity="warn")])


@_query(
    "q12_expect_range",
    _results_sql(
        "orders", _ORDERS,
        _rule_sql("range", "o_totalprice", "count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 400000)", "count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 400000) = 0 AND count(o_totalprice) > 0"),
        _rule_sql("range", "o_custkey", "count(*) FILTER (WHERE o_custkey < 1)", "count(*) FILTER (WHERE o_custkey < 1) = 0 AND count(o_custkey) > 0"),
    ),
)
def _(s, d):
    return co.contract_results(_orders(s, d), "orders", [co.Rule("range", "o_totalprice", low=0, high=400000), co.Rule("range", "o_custkey", low=1)])


_LAG = "DATE '2001-08-10' - max(try_cast(raw AS DATE))"


@_query(
    "q13_expect_freshness",
    _results_sql("orders", _ORDERS, _rule_sql("freshness", "raw", _LAG, f"{_LAG} <= 30 AND count(*) FILTER (WHERE raw IS NOT NULL AND try_cast(raw AS DATE) IS NULL) = 0")),
)
def _(s, d):
    return co.contract_results(_orders(s, d), "orders", [co.Rule("freshness", "raw", days=30)], "2001-08-10")


@_query("q14_expect_row_count", _results_sql("orders", _ORDERS, _rule_sql("row_count", "", "count(*)", "count(*) >= 1000")))
def _(s, d):
    return co.contract_results(_orders(s, d), "orders", [co.Rule("row_count", low=1000)])


@_query(
    "q16_model_tests",
    _results_sql(
        "impressions_aggregated", f"{IMPRESSIONS_SQL}, rows_of AS (FROM agg)",
        _rule_sql("not_null", "user_id", "count(*) FILTER (WHERE user_id IS NULL)", "count(*) FILTER (WHERE user_id IS NULL) = 0"),
        _rule_sql("unique", "impression_id", "count(impression_id) - count(DISTINCT impression_id)", "count(impression_id) = count(DISTINCT impression_id)"),
        _rule_sql("accepted_values", "page_type", "count(*) FILTER (WHERE page_type NOT IN (1, 2))", "count(*) FILTER (WHERE page_type NOT IN (1, 2)) = 0", "warn"),
        _rule_sql("accepted_values", "max_stage", "count(*) FILTER (WHERE max_stage NOT IN ('a', 'b', 'c', 'd', 'e', 'f'))", "count(*) FILTER (WHERE max_stage NOT IN ('a', 'b', 'c', 'd', 'e', 'f')) = 0"),
    ),
)
def _(s, d):
    model = [co.Rule("not_null", "user_id"), co.Rule("unique", "impression_id"), co.Rule("accepted_values", "page_type", (1, 2), severity="warn"), co.Rule("accepted_values", "max_stage", tuple("abcdef"))]
    return co.contract_results(an.impressions_aggregated(funnel_events(s, d)), "impressions_aggregated", model)


@_query(
    "q9_contract_counts",
    f"""{_I} SELECT count(*) AS n_rows, count(*) FILTER (WHERE user_id IS NULL) AS null_user_id, count(*) FILTER (WHERE date IS NULL) AS null_date,
    count(impression_id) - count(DISTINCT impression_id) AS duplicate_keys, count(*) FILTER (WHERE event_type NOT IN ('a','b','c','d','e','f')) AS bad_event_type FROM imp""",
)
def _(s, d):
    return rules.contract_counts(impressions(s, d), ["user_id", "date"], "impression_id", {"event_type": list("abcdef")})


@_query(
    "q3_quarantine_ratio",
    f"""WITH {STAGED_SQL} SELECT o_orderstatus, count(*) AS n_read, count(*) FILTER (WHERE try_cast(raw AS DATE) IS NULL) AS n_bad,
    count(*) FILTER (WHERE try_cast(raw AS DATE) IS NULL) <= count(*) * 0.01 AS holds FROM sto GROUP BY ALL""",
)
def _(s, d):
    per = staged_orders(s, d).groupBy("o_orderstatus").agg(F.count("*").alias("n_read"), F.count_if(F.try_to_date("raw").isNull()).alias("n_bad"))
    return per.withColumn("holds", mo.quarantine_ratio_holds(F.col("n_read"), F.col("n_bad")))


_MANIFESTS = """mf AS (SELECT page_type, hour, date, count(*) AS rows_read, count(*) FILTER (WHERE event_type < 'g') AS rows_written,
  count(*) FILTER (WHERE event_type = 'g') AS rows_quarantined FROM imp GROUP BY ALL)"""


@_query(
    "q5_slice_volume_audit",
    f"""{_I}, {_MANIFESTS}, ex AS (SELECT p.page_type, p.hour, q.date FROM (SELECT DISTINCT page_type, hour FROM mf) p,
      (SELECT unnest(generate_series(DATE '1995-03-01', DATE '1995-03-31', INTERVAL 1 DAY))::DATE AS date) q),
    bb AS (SELECT ex.page_type, ex.hour, ex.date, median(b.rows_written) AS baseline FROM ex JOIN mf b ON ex.page_type = b.page_type AND ex.hour = b.hour
      AND b.date >= ex.date - 7 AND b.date < ex.date GROUP BY ALL)
    SELECT page_type, hour, date::VARCHAR AS date, rows_written, baseline, CASE WHEN rows_written IS NULL THEN 'missing' WHEN rows_quarantined > rows_read * 0.01 THEN 'quarantine'
      WHEN rows_written = 0 THEN 'anomaly' WHEN coalesce(baseline, 0) = 0 THEN 'no_baseline' WHEN rows_written < baseline * 0.5 OR rows_written > baseline * 2 THEN 'anomaly' ELSE 'ok' END AS status
    FROM ex LEFT JOIN mf USING (page_type, hour, date) LEFT JOIN bb USING (page_type, hour, date)""",
)
def _(s, d):
    manifests = impressions(s, d).groupBy("page_type", "hour", "date").agg(F.count("*").alias("rows_read"), F.count_if(F.col("event_type") < "g").alias("rows_written"), F.count_if(F.col("event_type") == "g").alias("rows_quarantined"))
    days = F.sequence(F.lit("1995-03-01").cast("date"), F.lit("1995-03-31").cast("date"))
    expected = manifests.select("page_type", "hour").distinct().withColumn("date", F.explode(days))
    return co.slice_volume_audit(expected, manifests).withColumn("date", as_text("date"))


_JOBS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'running' ELSE 'failed' END"


@_query(
    "q6_run_freshness",
    f"""WITH j AS (SELECT o_custkey, epoch(TIMESTAMP '2001-08-03 00:00:00') - max(epoch(o_orderdate)) FILTER (WHERE {_JOBS} = 'completed') AS age FROM orders GROUP BY ALL)
    SELECT o_custkey, round(age / 3600, 2) AS hours, CASE WHEN round(age / 3600, 2) <= 8760 THEN 'ok' ELSE 'late' END AS status FROM j""",
)
def _(s, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "running").otherwise("failed")
    runs = table(s, d, "orders").select("o_custkey", status.alias("status"), F.col("o_orderdate").alias("updated_at"))
    return co.run_freshness(runs, "o_custkey", "2001-08-03 00:00:00", 8760)


@_query(
    "q7_source_freshness",
    """WITH x AS (SELECT user_id, epoch(TIMESTAMP '2024-01-31 00:00:00') - max(epoch(ts)) AS age FROM events GROUP BY ALL)
    SELECT user_id, CASE WHEN age > 24 * 3600 THEN 'error' WHEN age > 2 * 3600 THEN 'warn' ELSE 'ok' END AS status FROM x""",
)
def _(s, d):
    return co.source_freshness(table(s, d, "events"), "user_id", "ts", "2024-01-31 00:00:00")


@_query(
    "q20_monitor_duplicates",
    """SELECT l_returnflag, count(*) - count(DISTINCT l_orderkey * 100 + l_linenumber) AS duplicates,
    CASE WHEN count(*) > count(DISTINCT l_orderkey * 100 + l_linenumber) THEN 'breach' ELSE 'ok' END AS status FROM lineitem GROUP BY ALL""",
)
def _(s, d):
    n = F.count("*") - F.count_distinct(F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    per = table(s, d, "lineitem").groupBy("l_returnflag").agg(n.alias("duplicates"))
    return per.withColumn("status", co.monitor_status("duplicates", F.col("duplicates"), F.array().cast("array<bigint>")))


_DAILY = "daily AS (SELECT date, count(*) AS n, count(DISTINCT user_id) AS users FROM imp GROUP BY ALL)"
_TRAIL = "list_median(list({0}) OVER (ORDER BY daily.date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))".format
_RATIO = "CASE WHEN b IS NULL THEN 'ok' WHEN {0} < b * 0.5 THEN 'breach' WHEN {0} < b * 0.8 THEN 'warn' ELSE 'ok' END".format


@_query("q20_monitor_absolute", f"{_I}, {_DAILY}, x AS (SELECT *, {_TRAIL('n')} AS b FROM daily) SELECT date::VARCHAR AS date, n, CASE WHEN n > 40 THEN 'breach' ELSE {_RATIO('n')} END AS status FROM x")
def _(s, d):
    daily = impressions(s, d).groupBy("date").agg(F.count("*").alias("n")).withColumn("feed", F.lit("impressions"))
    seen = mo.trailing(daily, "feed", "date", "n")
    return seen.select(as_text("date"), "n", co.monitor_status("row_count", F.col("n"), F.col("history"), 40).alias("status"))


_MONITORS = [co.Monitor("rows", "row_count", "count(*)"), co.Monitor("users", "cardinality", "count(distinct user_id)"), co.Monitor("broken", "row_count", "sum(no_such_column)")]


@_query(
    "q22_run_monitors",
    f"""{_I}, {_DAILY}, x AS (SELECT date, n AS v, 'rows' AS monitor, {_TRAIL('n')} AS b FROM daily UNION ALL SELECT date, users, 'users', {_TRAIL('users')} FROM daily)
    SELECT monitor, date::VARCHAR AS run, v::DOUBLE AS metric, {_RATIO('v')} AS status FROM x UNION ALL SELECT 'broken', NULL, NULL, 'breach'""",
)
def _(s, d):
    return co.run_monitors("impressions", impressions(s, d), "date", _MONITORS).select("monitor", as_text("run"), "metric", "status")


_SNAPSHOTS = """y AS (SELECT o_orderstatus AS table_name, year(o_orderdate)::INT AS version, count(*) AS added FROM orders GROUP BY ALL),
sn AS (SELECT *, CASE WHEN version = 1997 THEN 'delete' WHEN version % 4 = 0 THEN 'overwrite' ELSE 'append' END AS operation,
  CASE WHEN version = 1997 THEN 0 ELSE added END AS total_rows FROM y),
rb AS (SELECT *, operation IN ('overwrite', 'replace') OR (operation = 'delete' AND total_rows = 0) OR (operation = 'append'
  AND coalesce(lag(operation = 'delete' AND total_rows = 0) OVER (PARTITION BY table_name ORDER BY version), false)) AS is_rebuild FROM sn)"""


def _snapshots(s, d):
    per = table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("table_name"), F.year("o_orderdate").alias("version")).agg(F.count("*").alias("added"))
    what = F.when(F.col("version") == 1997, "delete").when(F.col("version") % 4 == 0, "overwrite").otherwise("append")
    return per.withColumns({"operation": what, "total_rows": F.when(F.col("version") == 1997, F.lit(0)).otherwise(F.col("added")).cast("long")})


@_query("v15_is_full_rebuild", f"WITH {_SNAPSHOTS} SELECT table_name, version, is_rebuild FROM rb")
def _(s, d):
    return ve.full_rebuilds(_snapshots(s, d)).select("table_name", "version", "is_rebuild")


@_query("v4_history", f"WITH {_SNAPSHOTS} SELECT table_name, version, lag(version) OVER (PARTITION BY table_name ORDER BY version) AS parent, operation, added FROM sn")
def _(s, d):
    return ve.history(_snapshots(s, d)).select("table_name", "version", "parent", "operation", "added")


@_query("q21_latest_batch_rows", f"WITH {_SNAPSHOTS} SELECT table_name, arg_max(added, version) AS added FROM rb WHERE NOT is_rebuild GROUP BY ALL")
def _(s, d):
    return ve.latest_batch_rows(_snapshots(s, d))


_BATCHES = """bt AS (SELECT page_type, strftime(date, '%Y-%m') AS batch, count(*) AS n FROM imp GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY page_type ORDER BY batch DESC) AS k FROM bt),
md AS (SELECT page_type, max(batch) AS batch, max(n) FILTER (WHERE k = 1) AS n, median(n) FILTER (WHERE k > 1) AS baseline FROM rk GROUP BY ALL)"""


def _batches(s, d):
    return impressions(s, d).groupBy("page_type", F.date_format("date", "yyyy-MM").alias("batch")).agg(F.count("*").alias("n"))


@_query("w7_batch_vs_trailing_median", f"{_I}, {_BATCHES} SELECT * FROM md")
def _(s, d):
    return co.batch_against_median(_batches(s, d), "page_type", "batch", "n")


@_query("q28_volume_collapse", f"{_I}, {_BATCHES} SELECT page_type, batch, n, baseline FROM md WHERE n < baseline * 0.5")
def _(s, d):
    return co.volume_collapse(_batches(s, d), "page_type", "batch", "n")


@_query(
    "w10_latest_per_key_run",
    "SELECT user_id, ts::DATE::VARCHAR AS day, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) = 1",
)
def _(s, d):
    rows = co.latest_per_key_run(table(s, d, "events"), ["user_id"], "ts", "event_id")
    return rows.select("user_id", F.to_date("ts").cast("string").alias("day"), "event_id", "event_type")


_NAMES = """hi AS (SELECT o_orderstatus AS table_name, year(o_orderdate)::INT AS version, (o_custkey % 50)::INT AS field_id, min(o_orderpriority) AS name FROM orders GROUP BY ALL),
nw AS (SELECT * FROM hi SEMI JOIN (SELECT table_name, max(version) AS version FROM hi GROUP BY ALL) USING (table_name, version))"""


@_query(
    "q27_rename_map",
    f"""WITH {_NAMES} SELECT DISTINCT hi.table_name, hi.field_id, hi.name AS old_name, nw.name AS new_name FROM hi
    JOIN nw ON hi.table_name = nw.table_name AND hi.field_id = nw.field_id WHERE hi.name <> nw.name""",
)
def _(s, d):
    keys = [F.col("o_orderstatus").alias("table_name"), F.year("o_orderdate").alias("version"), (F.col("o_custkey") % 50).cast("int").alias("field_id")]
    return co.rename_map(table(s, d, "orders").groupBy(*keys).agg(F.min("o_orderpriority").alias("name")), "table_name")


@_query("q29_staleness", f"WITH {STAGED_SQL} SELECT o_orderstatus, (DATE '2001-08-10' - max(try_cast(raw AS DATE)))::INT AS lag_days FROM sto GROUP BY ALL HAVING DATE '2001-08-10' - max(try_cast(raw AS DATE)) > 7")
def _(s, d):
    newest = rules.date_health(staged_orders(s, d), "raw", ["o_orderstatus"])
    return newest.select("o_orderstatus", F.date_diff(F.lit("2001-08-10").cast("date"), "newest").alias("lag_days")).where("lag_days > 7")


@_query("q30_date_corruption", f"WITH {STAGED_SQL} SELECT o_custkey, count(*) AS unparsed FROM sto WHERE raw IS NOT NULL AND try_cast(raw AS DATE) IS NULL GROUP BY ALL")
def _(s, d):
    return rules.date_health(staged_orders(s, d), "raw", ["o_custkey"]).where("unparsed > 0").select("o_custkey", "unparsed")


@_query(
    "q31_enum_drift",
    f"""{_I} SELECT 'event_type' AS col, 'new_value' AS finding, event_type AS value FROM imp WHERE event_type > 'f' GROUP BY ALL
    UNION ALL SELECT 'impression_id', 'too_many_values', NULL UNION ALL SELECT 'no_such_column', 'column_absent', NULL""",
)
def _(s, d):
    rows, found = impressions(s, d), None
    for column, registered in (("event_type", list("abcdef")), ("impression_id", []), ("no_such_column", [])):
        part = co.enum_drift(rows, column, registered).select(F.lit(column).alias("col"), "finding", "value")
        found = part if found is None else found.unionByName(part)
    return found


_KINDS = ("schema", "schema", "schema", "enum", "enum", "volume", "stale", "other")
_CHANGES = ("added", "renamed", "type_changed", "column_absent", "no_values", "collapse", "dropped", "not_comparable", "too_many_values", "new_value")
_TYPES = ("int", "bigint", "float", "double", "string")


@_query(
    "q32_classify_findings",
    f"""WITH f AS (SELECT o_orderkey, ({list(_KINDS)})[o_orderkey % 8 + 1] AS kind, ({list(_CHANGES)})[o_custkey % 10 + 1] AS change,
      ({list(_TYPES)})[o_orderkey % 5 + 1] AS was, ({list(_TYPES)})[o_custkey % 5 + 1] AS now FROM orders)
    SELECT o_orderkey, 'orders|' || kind || '||' || change || '|' AS finding_key, CASE WHEN kind IN ('monitor', 'volume', 'stale', 'corrupt') THEN 'breaking'
      WHEN kind = 'enum' AND change IN ('column_absent', 'no_values') THEN 'breaking' WHEN kind = 'enum' AND change IN ('not_comparable', 'too_many_values') THEN 'benign' WHEN kind = 'enum' THEN 'enum_drift'
      WHEN kind <> 'schema' THEN 'benign' WHEN change = 'added' THEN 'additive' WHEN change = 'renamed' AND was = now THEN 'renaming'
      WHEN change = 'type_changed' AND ((was = 'int' AND now = 'bigint') OR (was = 'float' AND now = 'double')) THEN 'widening'
      WHEN change IN ('dropped', 'renamed', 'type_changed') THEN 'breaking' ELSE 'benign' END AS severity FROM f""",
)
def _(s, d):
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % len(values) + 1).cast("int"))
    none = F.lit(None).cast("string")
    findings = table(s, d, "orders").select(
        "o_orderkey", F.lit("orders").alias("table_name"), pick(_KINDS, "o_orderkey").alias("kind"), none.alias("column"), pick(_CHANGES, "o_custkey").alias("change"),
        none.alias("monitor"), pick(_TYPES, "o_orderkey").alias("type_was"), pick(_TYPES, "o_custkey").alias("type_now"),
    )
    return co.classify_findings(findings).select("o_orderkey", "finding_key", "severity")


_ALERTS = """al AS (SELECT DISTINCT user_id, ts::DATE AS run, CASE event_type WHEN 'error' THEN 'breach' ELSE 'warn' END AS status FROM events WHERE event_type IN ('error', 'purchase')),
rn AS (SELECT run, row_number() OVER (ORDER BY run) AS r FROM (SELECT DISTINCT ts::DATE AS run FROM events))"""


def _alerts(s, d):
    status = F.when(F.col("event_type") == "error", "breach").when(F.col("event_type") == "purchase", "warn").otherwise("ok")
    return table(s, d, "events").select("user_id", F.to_date("ts").alias("run"), status.alias("status")).distinct()


@_query(
    "q34_throttle_alerts",
    f"""WITH RECURSIVE {_ALERTS}, k AS (SELECT row_number() OVER (ORDER BY run) AS r, run, list({{'user_id': user_id, 'status': status}}) AS seen FROM al GROUP BY run),
    st AS (SELECT 0::BIGINT AS r, NULL::DATE AS run, (SELECT [seen] FROM k LIMIT 0) AS log, (SELECT seen FROM k LIMIT 0) AS sent
      UNION ALL SELECT r, run, CASE WHEN len(sent) > 0 THEN list_slice(list_append(coalesce(log, []), sent), -3, -1) ELSE log END, sent
        FROM (SELECT k.r, k.run, st.log, list_filter(k.seen, lambda x: NOT coalesce(list_contains(flatten(st.log), x), false)) AS sent FROM st JOIN k ON k.r = st.r + 1))
    SELECT s.user_id, run::VARCHAR AS run, s.status FROM (SELECT run, unnest(sent) AS s FROM st WHERE len(sent) > 0)""",
)
def _(s, d):
    return mo.throttled(_alerts(s, d), "user_id", "status", "run").withColumn("run", as_text("run")).select("user_id", "run", "status")


@_query(
    "q35_report_monitors",
    f"""{_I}, {_DAILY}, x AS (SELECT date, n::DOUBLE AS metric, n - lag(n) OVER (ORDER BY daily.date) AS delta, {_TRAIL('n')} AS b FROM daily WHERE date <= DATE '1996-06-30')
    SELECT 'rows' AS monitor, date::VARCHAR AS run, metric, {_RATIO('metric')} AS status, delta::DOUBLE AS delta FROM x ORDER BY x.date DESC LIMIT 1""",
)
def _(s, d):
    results = co.run_monitors("impressions", impressions(s, d), "date", _MONITORS[:1])
    return co.report_monitors(results, "1996-06-30").select("monitor", as_text("run"), "metric", "status", "delta")


@_query(
    "q35_report_incidents",
    f"""WITH {_ALERTS}, b AS (SELECT DISTINCT user_id, run FROM al WHERE status = 'breach' AND run <= DATE '2024-01-20'), n AS (SELECT max(run) AS newest FROM b),
    p AS (SELECT max(run) AS before FROM b, n WHERE run < newest)
    SELECT user_id, min(run)::VARCHAR AS first_seen, (newest - min(run))::INT AS age, CASE WHEN bool_or(run = before) THEN 'open' ELSE 'new' END AS state
    FROM b, n, p GROUP BY user_id, newest, before HAVING max(run) = newest""",
)
def _(s, d):
    found = _alerts(s, d).where("status = 'breach'")
    return co.report_incidents(found, "user_id", "run", "2024-01-20").withColumn("first_seen", as_text("first_seen"))


_LOG = f"""{_ALERTS}, lg AS (SELECT user_id::VARCHAR AS finding_key, ts::DATE AS run, ts AS seen_at, event_id FROM events WHERE event_type = 'error'), rs AS (SELECT DISTINCT ts::DATE AS run FROM events),
pv AS (SELECT max(run) AS run FROM rs WHERE run < DATE '2024-01-20'), ks AS (SELECT finding_key, min(lg.run) AS first_seen, coalesce(bool_or(lg.run = pv.run), false) AS was, bool_or(lg.run = DATE '2024-01-20') AS now_there
  FROM lg, pv WHERE lg.run <= DATE '2024-01-20' GROUP BY ALL)"""


def _report(s, d):
    e = table(s, d, "events").withColumn("run", F.to_date("ts"))
    log = e.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("finding_key"), "run", F.col("ts").alias("at"), "event_id")
    results = s.createDataFrame([], "feed string, monitor string, run date, metric double, status string")
    return co.daily_report(log, results, _alerts(s, d).where("status <> 'ok'"), e.select("run").distinct(), "2024-01-20")


@_query(
    "q35_report_findings",
    f"""WITH {_LOG} SELECT finding_key, event_id, first_seen::VARCHAR AS first_seen, (DATE '2024-01-20' - first_seen)::INT AS age, CASE WHEN was THEN 'open' ELSE 'new' END AS state
    FROM (SELECT * FROM lg WHERE run = DATE '2024-01-20' QUALIFY row_number() OVER (PARTITION BY finding_key ORDER BY seen_at DESC, event_id DESC) = 1) JOIN ks USING (finding_key)""",
)
def _(s, d):
    return _report(s, d)["findings"].select("finding_key", "event_id", as_text("first_seen"), "age", "state")


@_query("q35_report_cleared", f"WITH {_LOG} SELECT finding_key, first_seen::VARCHAR AS first_seen, pv.run::VARCHAR AS last_seen FROM ks, pv WHERE was AND NOT now_there")
def _(s, d):
    return _report(s, d)["cleared"].select("finding_key", as_text("first_seen"), as_text("last_seen"))


@_query("q35_report_alerts", f"WITH {_LOG} SELECT user_id, status FROM al WHERE run = DATE '2024-01-20'")
def _(s, d):
    return _report(s, d)["alerts"].select("user_id", "status")
