"""Exact quantiles of large groups by counting, without any group's values in one place."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Buckets of one counting pass are 2 to this power.
BITS = 12


def same_keys(keys: list[str], others: list[str]) -> Column:
    """Keys of two sides are equal, nulls too."""
    return functools.reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(keys, others, strict=True)], F.lit(True))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, ps: dict[str, float], bits: int = BITS) -> DataFrame:
    """(keys, one double for each name in ``ps``): quantiles of whole-number values between neighbouring ranks, as ``percentile`` gives them.

    Equal values are counted where they lie.  Each pass then counts, for every rank that is sought, the values in its
    interval by ``2 ** bits`` equal buckets; the bucket that holds the rank is the next interval, until it is one value.  A
    group's range of 2^24 takes two passes.  No task holds more than the buckets of its ranks; the driver gets one number,
    the widest range.  Null values count for nothing, groups of nulls alone give null; null keys are a group.
    """
    if not isinstance(rows.schema[value].dataType, T.IntegralType):
        raise ValueError(f"{value} holds no whole numbers")
    if any(not 0 <= p <= 1 for p in ps.values()):
        raise ValueError("quantiles lie from 0 to 1")
    counts = rows.groupBy(*keys, F.col(value).cast("long").alias("_value")).agg(F.count("*").alias("_n")).persist()
    sizes = counts.groupBy(*keys).agg(F.sum(F.when(F.col("_value").isNotNull(), F.col("_n"))).alias("_size"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
    span = int(sizes.agg(F.max(F.col("_hi").cast("decimal(20,0)") - F.col("_lo"))).first()[0] or 0) + 1
    if span > 1 << 62:
        raise ValueError(f"{value} spans more than 2 to the power of 62")
    passes = max(1, math.ceil((span - 1).bit_length() / bits))
    # ranks from 0: of each quantile the one at or below its place, and the one above
    places = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.cast("long").alias("rank")) for name, p in ps.items() for side, rank in (("low", F.floor((F.col("_size") - 1) * p)), ("high", F.ceil((F.col("_size") - 1) * p)))])
    others = [f"_key{k}" for k in range(len(keys))]
    named = [F.col(a).alias(b) for a, b in zip(keys, others, strict=True)]
    sought = sizes.where("_size > 0").select(*named, "_lo", F.explode(places).alias("_s")).select(*others, "_lo", F.col("_s.name").alias("_name"), F.col("_s.side").alias("_side"), F.col("_s.rank").alias("_rank"))
    mine = [*others, "_name", "_side", "_rank", "_lo"]
    for left in reversed(range(passes)):
        width = 1 << bits * left
        reach = F.col("_value") - F.col("_lo")
        near = counts.join(sought, same_keys(keys, others)).select(*mine, "_value", "_n")
        near = near.where((reach >= 0) & (reach < width << bits) if left < passes - 1 else F.col("_value").isNotNull())
        buckets = near.groupBy(*mine, F.floor(reach / width if width == 1 else F.expr(f"(_value - _lo) div {width}")).alias("_b")).agg(F.sum("_n").alias("_n"))
        until = F.sum("_n").over(Window.partitionBy(*others, "_name", "_side").orderBy("_b"))  # at most 2 ** bits rows
        found = buckets.withColumn("_until", until).where((F.col("_until") > F.col("_rank")) & (F.col("_until") - F.col("_n") <= F.col("_rank")))
        sought = found.select(*others, "_name", "_side", (F.col("_rank") - F.col("_until") + F.col("_n")).alias("_rank"), (F.col("_lo") + F.col("_b") * width).alias("_lo"))
    at = lambda name, side: F.max(F.when((F.col("_name") == name) & (F.col("_side") == side), F.col("_lo"))).alias(f"_{side}_{name}")
    values = sought.groupBy(*others).agg(*[at(name, side) for name in ps for side in ("low", "high")])
    both = sizes.join(values, same_keys(keys, others), "left")
    place = lambda p: (F.col("_size") - 1) * p
    part = lambda p: place(p) - F.floor(place(p))
    return both.select(*keys, *[(F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * part(p)).cast("double").alias(n) for n, p in ps.items()])
