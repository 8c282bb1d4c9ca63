"""Impression analyses: funnel, page summary, engagement, traffic; frames in, frames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweir.functions.scalars import compose_ts, pct2, ratio
from tallyweir.operators.joins import hot_salted_join, small

JOIN_STRATEGIES = ("broadcast", "salted", "plain")


def _mean2(total: Column, n: Column) -> Column:
    return ratio(total, n, 2)


def _stage_bits() -> Column:
    """The stages of a group, which are single letters, one bit each: no list to keep, and rows are shuffled once."""
    return F.bit_or(F.expr("shiftleft(1L, ascii(event_type) % 64)"))


def _distinct_stages() -> Column:
    return F.bit_count(_stage_bits()).cast("long")


def _deepest(bits: Column) -> Column:
    """The greatest letter among stage bits."""
    return F.chr((F.length(F.bin(bits)) + 63).cast("long"))


def impressions_aggregated(events: DataFrame) -> DataFrame:
    """One row per impression; events without a date are left out.

    Only whole numbers are aggregated, so that rows are hashed and not sorted: stages as bits, moments as seconds of their
    hour, which is a key; texts and timestamps are made of them afterwards.
    """
    inside = F.col("min").between(0, 59) & F.col("second").between(0, 59)
    moment = F.when(inside, F.col("min") * 60 + F.col("second"))
    per = events.where("date is not null").groupBy("user_id", "impression_id", "page_type", "date", "hour").agg(
        F.count("*").alias("event_count"), _stage_bits().alias("_bits"), F.min("second").alias("first_second"), F.max("second").alias("last_second"), F.min(moment).alias("_first"), F.max(moment).alias("_last")
    )
    at = lambda c: compose_ts(F.col("date"), F.col("hour"), F.floor(F.col(c) / 60).cast("int"), F.col(c) % 60)
    return per.select(
        "user_id", "impression_id", "page_type", "date", "hour", "event_count", F.coalesce(F.bit_count("_bits"), F.lit(0)).cast("long").alias("distinct_events"),
        "first_second", "last_second", at("_first").alias("first_ts"), at("_last").alias("last_ts"), _deepest(F.col("_bits")).alias("max_stage"),
    )


def hour_aggregate(events: DataFrame, date: str, hour: int, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """Impressions of one hour, with further columns of the events to group by."""
    rows = events.where((F.col("date") == F.lit(date).cast("date")) & (F.col("hour") == hour))
    return rows.groupBy("user_id", "impression_id", "page_type", *dimensions).agg(
        F.count("*").alias("event_count"),
        _distinct_stages().alias("distinct_events"),
        F.min("second").alias("first_second"),
        F.max("second").alias("last_second"),
    )


def lake_aggregate(events: DataFrame) -> DataFrame:
    """By impression, user and page: day of the first event, depth, deepest stage, first and last timestamp."""
    at = compose_ts(F.col("date"), F.col("hour"), F.col("min"), F.col("second"))
    return events.groupBy("impression_id", "user_id", "page_type").agg(
        F.to_date(F.min(at)).alias("date"), F.count("*").alias("depth"), F.max("event_type").alias("max_stage"), F.min(at).alias("first_ts"), F.max(at).alias("last_ts")
    )


def funnel(events: DataFrame) -> DataFrame:
    """Distinct impressions of each page and stage. Events are shuffled once, by impression; all else is a few rows."""
    one = events.where("impression_id is not null").groupBy("page_type", "impression_id").agg(_stage_bits().alias("_bits"))
    letters = F.expr("transform(filter(sequence(ascii('a'), ascii('z')), x -> getbit(_bits, x % 64) = 1), x -> chr(x))")
    each = one.select("page_type", F.explode(F.array_append(letters, F.lit(None).cast("string"))).alias("event_type"))
    counts = each.groupBy("page_type", "event_type").agg(F.count("*").alias("impressions"))
    page = Window.partitionBy("page_type")
    counts = counts.withColumn("total", F.max(F.when(F.col("event_type").isNull(), F.col("impressions"))).over(page)).where("event_type is not null")
    before = F.lag("impressions").over(page.orderBy("event_type"))
    return counts.select(
        "page_type", "event_type", "impressions", "total",
        pct2(F.col("impressions"), F.col("total")).alias("pct_of_total"),
        pct2(F.col("impressions"), before).alias("pct_from_previous"),
    )


def _reaching(stage: str) -> Column:
    return F.count_if(F.col("max_stage") >= stage)


def page_type_summary(aggregated: DataFrame) -> DataFrame:
    n = F.count("*")
    return aggregated.groupBy("page_type").agg(
        n.alias("impressions"),
        F.count_distinct("user_id").alias("users"),
        _mean2(F.sum("distinct_events"), n).alias("avg_depth"),
        F.max("distinct_events").alias("max_depth"),
        _mean2(F.sum(F.col("last_second") - F.col("first_second")), n).alias("avg_duration"),
        *[_reaching(s).alias(f"reaching_{s}") for s in "def"],
        *[pct2(_reaching(s), n).alias(f"pct_reaching_{s}") for s in "def"],
    )


def _per_user_and_page(aggregated: DataFrame) -> DataFrame:
    return aggregated.groupBy("user_id", "page_type").agg(
        F.count("*").alias("n"), F.sum("distinct_events").alias("depth"), F.max("distinct_events").alias("max_depth"),
        F.sum("event_count").alias("events"), F.min("first_ts").alias("first_seen"), F.max("last_ts").alias("last_seen"),
    )


def _top() -> Column:
    """The page with most impressions, ties to the smaller page."""
    return F.max(F.struct("n", (-F.col("page_type")).alias("_page")))


def top_page_per_user(aggregated: DataFrame) -> DataFrame:
    per = aggregated.groupBy("user_id", "page_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(_top().alias("_top"))
    return per.select("user_id", (-F.col("_top._page")).alias("top_page"), F.col("_top.n").alias("top_page_count"))


def user_engagement(aggregated: DataFrame) -> DataFrame:
    """One row per user, from partial rows by user and page, which also tell the top page."""
    n = F.sum("n")
    per = _per_user_and_page(aggregated).groupBy("user_id").agg(
        n.alias("impressions"), F.count("*").alias("pages"), _mean2(F.sum("depth"), n).alias("avg_depth"), F.max("max_depth").alias("max_depth"),
        F.sum("events").alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), _top().alias("_top"),
    )
    return per.withColumns({"top_page": -F.col("_top._page"), "top_page_count": F.col("_top.n")}).drop("_top")


def hourly_traffic(aggregated: DataFrame) -> DataFrame:
    n = F.count("*")
    return aggregated.groupBy("date", "hour", "page_type").agg(
        n.alias("impressions"), F.count_distinct("user_id").alias("users"), _mean2(F.sum("distinct_events"), n).alias("avg_depth"),
        _reaching("d").alias("reaching_d"), pct2(_reaching("d"), n).alias("pct_reaching_d"),
    )


def top_engaged_users(aggregated: DataFrame, least: int, n: int) -> DataFrame:
    per = aggregated.groupBy("user_id").agg(F.count("*").alias("impressions")).where(F.col("impressions") >= least)
    return per.orderBy(F.desc("impressions"), "user_id").limit(n)


def engagement_ranking(engagement: DataFrame) -> DataFrame:
    return engagement.orderBy(F.desc("impressions"), "user_id")


def daily_volume(aggregated: DataFrame, days: int) -> DataFrame:
    """Impressions and users by date and page for the newest ``days`` days."""
    daily = aggregated.groupBy("date", "page_type").agg(F.count("*").alias("impressions"), F.count_distinct("user_id").alias("users"))
    return recent_days(daily, days)


def recent_days(daily: DataFrame, days: int) -> DataFrame:
    newest = daily.select("date").distinct().orderBy(F.desc("date")).limit(days)
    return daily.join(newest, "date", "left_semi")


def conversion_trend(aggregated: DataFrame, days: int) -> DataFrame:
    """The newest ``days`` days in ascending order, with the share that reaches stage d."""
    n = F.count("*")
    per = aggregated.groupBy("date").agg(n.alias("impressions"), _reaching("d").alias("reaching_d"), pct2(_reaching("d"), n).alias("pct_reaching_d"))
    return per.orderBy(F.desc("date")).limit(days).orderBy("date")


def deduplicate_latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def missing_periods(days: DataFrame, date: str = "date", keys: list[str] | None = None) -> DataFrame:
    """Days between the first and the last of each key (of all rows without keys) that have no row."""
    keys = keys or []
    span = days.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b")).where("_a is not null")
    calendar = span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias("date"))
    return calendar.join(days.select(*keys, F.col(date).alias("date")).distinct(), [*keys, "date"], "left_anti")


def enrich(events: DataFrame, users: DataFrame, key: str, strategy: str = "broadcast", how: str = "left") -> DataFrame:
    """Users' columns for each event; unmatched events stay with nulls.

    ``broadcast`` sends the users to every task if they are ``small``, and salts hot keys if not.
    """
    if strategy not in JOIN_STRATEGIES:
        raise ValueError(f"{strategy!r} is none of {JOIN_STRATEGIES}")
    if strategy == "plain":
        return events.join(users, key, how)
    if strategy == "broadcast" and small(users):
        return events.join(F.broadcast(users), key, how)
    return enrich_salted(events, users, key, how=how)


def enrich_salted(events: DataFrame, users: DataFrame, key: str, salts: int = 10, how: str = "left") -> DataFrame:
    """Join in which hot keys are spread over ``salts`` partitions; columns come as the key, those of the events, those of the users."""
    return hot_salted_join(events, users, key, salts, how)


def two_phase_distinct(rows: DataFrame, key: str, value: str, salts: int = 16) -> DataFrame:
    """Exact distinct values per key without bringing a hot key's values together."""
    part = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    part = part.groupBy(key, "_salt").agg(F.count_distinct(value).alias("_n"))
    return part.groupBy(key).agg(F.sum("_n").alias("distinct_values"))
