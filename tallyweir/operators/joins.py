"""Joins whose keys are uneven: broadcasts of a checked size, and keys that are spread only where they are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may be broadcast.
MOST_ROWS, MOST_BYTES = 1_000_000, 64 << 20
#: Keys that a summary keeps track of, and those of them that may count as hot.
TRACKED, MOST_HOT = 4096, 256


def small(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> bool:
    """Whether ``rows`` has at most so many rows and bytes of text, by counting no more than ``most_rows + 1`` of them."""
    width = F.octet_length(F.to_json(F.struct(*rows.columns)))
    n, total = rows.limit(most_rows + 1).agg(F.count("*"), F.sum(width.cast("long"))).first()
    return n <= most_rows and (total or 0) <= most_bytes


def hot_keys(rows: DataFrame, key: str, share: float = 0.01, tracked: int = TRACKED, most: int = MOST_HOT) -> list:
    """Keys with about ``share`` of all rows or more, by one pass with a mergeable summary of ``tracked`` keys.

    Counts may be off by up to the rows over 0.75 times ``tracked``, well under ``share``.  At most ``most`` keys reach the
    driver, the most frequent first; the null key matches nothing and is none of them.
    """
    kept = rows.where(F.col(key).isNotNull())
    n, top = kept.agg(F.count("*").alias("n"), F.call_function("approx_top_k", F.col(key), F.lit(most), F.lit(tracked)).alias("top")).first()
    return [x["item"] for x in top or [] if x["count"] >= max(share * n, 2)] if n else []


def salted(rows: DataFrame, key: str, hot: list, salts: int) -> DataFrame:
    """``_salt`` by a hash of the row for hot keys, 0 for all others."""
    return rows.withColumn("_salt", F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(0))


def spread(rows: DataFrame, key: str, hot: list, salts: int) -> DataFrame:
    """Rows of hot keys once for each salt, all others once, with salt 0."""
    return rows.withColumn("_salt", F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))


def hot_salted_join(large: DataFrame, other: DataFrame, key: str, salts: int = 10, how: str = "left", share: float = 0.01) -> DataFrame:
    """Join in which the rows of hot keys are spread over ``salts`` parts; all other keys stay as they are.

    ``other`` is written once, but for its rows of hot keys, which are written ``salts`` times.  The salt is a hash of the
    row, so that retries agree.  Columns come as the key, those of ``large``, those of ``other``.  Null keys match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"{how!r} can't be salted")
    hot = hot_keys(large, key, share)
    names = [key, *[c for c in large.columns if c != key], *[c for c in other.columns if c != key]]
    if not hot:
        return large.join(other, key, how).select(*names)
    return salted(large, key, hot, salts).join(spread(other, key, hot, salts), [key, "_salt"], how).select(*names)


def joined_counts(large: DataFrame, other: DataFrame, key: str, of_large: list[str], of_other: list[str], name: str = "events") -> DataFrame:
    """Rows of the inner join by columns of both sides, without joining row by row.

    ``large`` is counted by key and its own columns first, so that a hot key comes to the join as a few rows; ``other`` is
    counted likewise, and the products of the counts are the rows of the join.
    """
    mine = large.where(F.col(key).isNotNull()).groupBy(key, *of_large).agg(F.count("*").alias("_n"))
    theirs = other.where(F.col(key).isNotNull()).groupBy(key, *of_other).agg(F.count("*").alias("_m"))
    return mine.join(theirs, key).groupBy(*of_other, *of_large).agg(F.sum(F.col("_n") * F.col("_m")).alias(name))
