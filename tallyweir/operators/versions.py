"""Row versions with ``valid_from`` and ``valid_to``: history, roll back, expiry, hash sync."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def versions_of(changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Each change valid from its version until the next one of the key."""
    after = F.lead(version).over(Window.partitionBy(*keys).orderBy(version))
    return changes.withColumn("valid_to", after).withColumnRenamed(version, "valid_from")


def as_of(rows: DataFrame, version: int) -> DataFrame:
    return rows.where((F.col("valid_from") <= version) & (F.col("valid_to").isNull() | (F.col("valid_to") > version)))


def rolled_back(rows: DataFrame, to: int, new: int) -> DataFrame:
    """History with the state of version ``to`` again from version ``new`` on; states of before stay readable."""
    closed = rows.withColumn("valid_to", F.coalesce("valid_to", F.lit(new).cast(rows.schema["valid_to"].dataType)))
    again = as_of(rows, to).withColumns({"valid_from": F.lit(new).cast(rows.schema["valid_from"].dataType), "valid_to": F.lit(None).cast(rows.schema["valid_to"].dataType)})
    return closed.unionByName(again)


def as_of_time(rows: DataFrame, snapshots: DataFrame, at: str) -> DataFrame:
    """State of the newest snapshot (version, committed_at) at or before ``at``; none before the first one."""
    newest = snapshots.where(F.col("committed_at") <= F.lit(at).cast("timestamp_ntz")).agg(F.max("version")).first()[0]
    return rows.limit(0) if newest is None else as_of(rows, newest)


def expired(rows: DataFrame, snapshots: DataFrame, before: int, keep: int = 5) -> DataFrame:
    """Without rows closed at or before version ``before``; the last ``keep`` snapshots stay readable."""
    kept = snapshots.orderBy(F.desc("version")).limit(keep).agg(F.min("version")).first()[0]
    cutoff = before if kept is None else min(before, kept)
    return rows.where(F.col("valid_to").isNull() | (F.col("valid_to") > cutoff))


def history(snapshots: DataFrame) -> DataFrame:
    """Snapshots with their parent: version, parent, committed_at, operation, added, deleted."""
    parent = F.lag("version").over(Window.partitionBy("table_name").orderBy("version"))
    return snapshots.withColumn("parent", parent)


def full_rebuilds(snapshots: DataFrame) -> DataFrame:
    """``is_rebuild``: an overwrite or replace, a delete that clears the table, or an append right after such a delete."""
    ordered = Window.partitionBy("table_name").orderBy("version")
    clears = (F.col("operation") == "delete") & (F.col("total_rows") == 0)
    after_clear = (F.col("operation") == "append") & F.coalesce(F.lag(clears).over(ordered), F.lit(False))
    return snapshots.withColumn("is_rebuild", F.col("operation").isin("overwrite", "replace") | clears | after_clear)


def latest_batch_rows(snapshots: DataFrame) -> DataFrame:
    """(table_name, added): rows of each table's newest snapshot that isn't a rebuild."""
    each = full_rebuilds(snapshots).where(~F.col("is_rebuild"))
    return each.groupBy("table_name").agg(F.max_by("added", "version").alias("added"))


def sync_by_hash(target: DataFrame, source: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): inserted, updated, deleted or unchanged, by comparing digests."""
    t, s = target.select(key, F.col(digest).alias("_t")), source.select(key, F.col(digest).alias("_s"))
    action = F.when(F.col("_t").isNull(), "inserted").when(F.col("_s").isNull(), "deleted").when(F.col("_t") == F.col("_s"), "unchanged").otherwise("updated")
    return t.join(s, key, "full_outer").select(key, action.alias("action"))
