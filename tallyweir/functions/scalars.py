"""Column functions that the queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
TOKEN = "[a-z0-9']+"


def safe_date(raw: Column) -> Column:
    """An ISO date, or null for any other text."""
    return F.when(raw.rlike(ISO_DATE), F.try_to_date(raw, "yyyy-MM-dd"))


def compose_ts(date: Column, hour: Column, minute: Column, second: Column) -> Column:
    return F.make_timestamp(F.year(date), F.month(date), F.day(date), hour, minute, second)


def safe_event_ts(date: Column, hour: Column, minute: Column, second: Column) -> Column:
    """The composed timestamp where each part is in its range, else null."""
    fits = date.isNotNull() & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    return F.when(fits, compose_ts(date, hour, minute, second))


def date_prefix(raw: Column) -> Column:
    """The date that an ISO date or ISO timestamp text begins with; null for any other text."""
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd"))


def parse_text_ts(raw: Column) -> Column:
    return F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss"))


def ts_text(ts: Column) -> Column:
    """A timestamp as SQL writes it: no sign before years of five digits, ``(BC)`` after days before year 1, where Spark counts from 0 down."""
    text, year = ts.cast("string"), F.year(ts)
    before = F.concat(F.format_string("%04d", 1 - year), F.regexp_replace(text, r"^-?\d+(-\d\d-\d\d)", "$1 (BC)"))
    return F.when(year < 1, before).otherwise(F.ltrim(text, F.lit("+")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def pipe_key(*parts: Column) -> Column:
    """Parts joined by ``|``, null as nothing between its bars."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def json_pack(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def clamp_delta(now: Column, before: Column) -> Column:
    """Signed change; null without a value before, 0 where the change is under 1e-9 of the larger value."""
    same = F.abs(now - before) <= F.greatest(F.abs(now), F.abs(before)) * 1e-9
    return F.when(before.isNull() | now.isNull(), F.lit(None).cast("double")).when(same, F.lit(0.0)).otherwise((now - before).cast("double"))


def ratio(n: Column, d: Column, places: int) -> Column:
    """n / d to so many places, half away from zero; null where d is 0 or null."""
    return F.round(F.try_divide(n.cast("decimal(20,4)"), d.cast("decimal(20,0)")), places).cast("double")


def pct2(n: Column, d: Column) -> Column:
    """Percentage to two places; null where d is 0 or null."""
    return F.round(F.try_divide(n.cast("decimal(20,4)") * 100, d.cast("decimal(20,0)")), 2).cast("double")
