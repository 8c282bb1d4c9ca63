"""Change streams: their envelopes, running tables by key, and ingest that counts what it loses."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tallyweir.sources.shared import Folder, Pointer

OPS = ("c", "r", "u", "d")


def _fields(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def decode_changes(raw: DataFrame, schema: T.StructType | str, former: dict[str, list[str]] | None = None, column: str = "value", at: Column | str | None = None) -> DataFrame:
    """Change records in JSON as rows: the reader's fields, ``op``, ``source_ms``, ``sequence``, ``event_ts``, ``reason`` and ``raw``.

    A record is an envelope (``before``, ``after``, ``op``, ``source`` with ``ts_ms`` and maybe ``lsn``), alone or under
    ``payload``, or a flat row with ``__op``, ``__source_ts_ms`` and maybe ``__lsn``.  The values are those of ``after``,
    for deletes those of ``before``; a delete may lack its ``after`` or hold an empty one.  The reader's fields are fixed: a field added at the
    source is ignored, a dropped one reads null, and so does a renamed one unless ``former`` names what it was or has become.

    ``reason`` is null for a good record, else malformed (no JSON object), no_op, no_time or no_row; a null record, by which
    a log marks a deleted key for its own compaction, is tombstone.  ``sequence`` is 0 where the source gives none.
    """
    fields, former = _fields(schema), former or {}
    names = [*fields.fields, *(T.StructField(old, f.dataType) for f in fields for old in former.get(f.name, []))]
    row = T.StructType(names)
    source = T.StructType().add("ts_ms", "long").add("lsn", "long")
    body = [T.StructField("before", row), T.StructField("after", row), T.StructField("op", T.StringType()), T.StructField("source", source)]
    flat = [T.StructField("__op", T.StringType()), T.StructField("__source_ts_ms", T.LongType()), T.StructField("__lsn", T.LongType())]
    taken = {f.name for f in body}
    whole = T.StructType([*body, T.StructField("payload", T.StructType(body)), *flat, *(f for f in names if f.name not in taken), T.StructField("_bad", T.StringType())])
    text = F.col(column).cast("string")
    parsed = raw.withColumn("_j", F.from_json(text, whole, {"columnNameOfCorruptRecord": "_bad"}))
    j = F.col("_j")
    get = lambda name: F.coalesce(j[name], j["payload"][name])
    op = F.coalesce(get("op"), j["__op"])
    millis = F.coalesce(get("source")["ts_ms"], j["__source_ts_ms"])
    unwrapped = j["__op"].isNotNull()
    image = F.when(op == "d", get("before")).otherwise(get("after"))

    def value(f: T.StructField) -> Column:
        inside = [image[n] for n in (f.name, *former.get(f.name, []))]
        beside = [j[n] for n in (f.name, *former.get(f.name, [])) if n not in taken]
        return F.when(unwrapped, F.coalesce(*beside, F.lit(None))).otherwise(F.coalesce(*inside)).cast(f.dataType).alias(f.name)

    reason = (
        F.when(text.isNull(), "tombstone").when(j.isNull() | j["_bad"].isNotNull() | ~F.startswith(F.ltrim(text), F.lit("{")), "malformed")
        .when(op.isNull() | ~op.isin(*OPS), "no_op").when(millis.isNull(), "no_time").when(~unwrapped & image.isNull(), "no_row")
    )
    return parsed.select(
        *map(value, fields), op.alias("op"), millis.alias("source_ms"), F.coalesce(get("source")["lsn"], j["__lsn"], F.lit(0)).cast("long").alias("sequence"),
        F.timestamp_millis(millis).alias("event_ts"), reason.alias("reason"), text.alias("raw"),
    )


class KeyedTable:
    """The newest row of each key of a change stream, in files, with readers that always see one state.

    Every micro-batch writes the last change of each of its keys under its own number, so that a replayed batch writes the
    same files again.  ``compact`` folds all batches so far into the base: of ``buckets`` buckets by key only those that
    were touched are written anew, into new files, and a ``Pointer`` then names the base's files and the last batch that is
    in them, in one step.  A reader takes the pointer once: it sees base and batches as before or as after, never both.
    What is stored is bounded by the live keys, the batches since the last ``compact`` and one superseded base.

    Deleted keys stay as tombstones, so that a late change does not bring them back, until a ``compact`` is given a
    ``horizon`` that their order has passed; from then on changes older than the horizon are refused.  Of changes of one
    key the greatest by ``order`` counts, equal ones by operation and content.  A null in ``order`` sorts first.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], order: tuple[str, ...] = ("source_ms", "sequence"), buckets: int = 16):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets
        self.fields = _fields(schema)
        extra = [T.StructField(c, T.LongType()) for c in order if c not in self.fields.names]
        self.stored = T.StructType([*self.fields.fields, *extra, T.StructField("op", T.StringType())])
        self.pointer = Pointer(spark, f"{self.path}/current")
        self.folder = Folder(spark, self.path)

    def _newest(self, rows: DataFrame) -> DataFrame:
        names = self.stored.names
        rank = F.struct(*self.order, F.col("op"), F.xxhash64(*names))
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*names), rank).alias("_row")).select("_row.*")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, changes: DataFrame, batch: int) -> DataFrame:
        """Takes the changes of one batch; gives those that it refuses because they are older than the horizon."""
        rows = changes.select(*self.stored.names)
        horizon = self.pointer.read()[1].get("horizon")
        old = F.lit(False) if horizon is None else F.coalesce(F.col(self.order[0]) < horizon, F.lit(True))
        out = self._newest(rows.where(~old)).withColumn("batch", F.lit(batch).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/batches")
        return rows.where(old)

    def _parts(self, value: dict, buckets: Iterable[int] | None = None) -> tuple[DataFrame, DataFrame]:
        """(base, batches) of one state of the pointer."""
        paths = [f"{self.path}/{p}" for b, p in value.get("base", {}).items() if buckets is None or int(b) in set(buckets)]
        none = self.spark.createDataFrame([], self.stored)
        base = self.spark.read.schema(self.stored).parquet(*paths) if paths else none
        numbered = T.StructType([*self.stored.fields, T.StructField("batch", T.LongType())])
        new = self.spark.read.schema(numbered).parquet(f"{self.path}/batches") if self.folder.exists("batches") else self.spark.createDataFrame([], numbered)
        return base, new.where(F.col("batch") > value.get("through", -1))

    def current(self, tombstones: bool = False) -> DataFrame:
        """The table as it is now, deleted keys left out unless asked for."""
        base, new = self._parts(self.pointer.read()[1])
        rows = self._newest(base.unionByName(new.drop("batch")))
        return rows if tombstones else rows.where("op <> 'd'").select(*self.fields.names)

    def compact(self, horizon: int | None = None) -> bool:
        """Folds the batches into the base; whether there was anything to fold. Another one at the same time raises ``Conflict`` in one of the two."""
        version, value = self.pointer.read()
        done = [int(n.split("=")[1]) for n in Folder(self.spark, f"{self.path}/batches").names() if n.startswith("batch=")]
        through = max(done, default=-1)
        if through <= value.get("through", -1) and horizon is None:
            return False
        _, new = self._parts(value)
        new = new.where(F.col("batch") <= through).drop("batch")
        touched = [r[0] for r in new.select(self._bucket()).distinct().collect()] if horizon is None else list(range(self.buckets))  # numbers of buckets
        base, _ = self._parts(value, touched)
        rows = self._newest(base.unionByName(new))
        if horizon is not None:
            rows = rows.where(~((F.col("op") == "d") & (F.coalesce(F.col(self.order[0]), F.lit(horizon - 1)) < horizon)))
        name = f"base/version={version + 1}-{uuid.uuid4().hex[:12]}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")
        written = [int(n.split("=")[1]) for n in Folder(self.spark, f"{self.path}/{name}").names() if n.startswith("bucket=")]
        now = {b: p for b, p in value.get("base", {}).items() if int(b) not in touched} | {str(b): f"{name}/bucket={b}" for b in written}
        was = value.get("horizon")
        self.pointer.swap(version, {"through": max(through, value.get("through", -1)), "base": now, "horizon": was if horizon is None else max(horizon, was or horizon)})
        return True

    def vacuum(self) -> None:
        """Deletes batches and bases that neither the present nor the previous state names; readers of older ones must be done."""
        version, value = self.pointer.read()
        if version < 2:
            return
        before = json.loads(self.pointer.folder.read(f"{version - 1:020d}.json"))
        named = {p.split("/")[1] for v in (value, before) for p in v.get("base", {}).values()}
        for name in Folder(self.spark, f"{self.path}/base").names():
            if name.startswith("version=") and name not in named and int(name[8:].split("-")[0]) <= version:
                self.folder.delete(f"base/{name}")
        for name in Folder(self.spark, f"{self.path}/batches").names():
            if name.startswith("batch=") and int(name[6:]) <= before.get("through", -1):
                self.folder.delete(f"batches/{name}")
        self.pointer.forget(keep=2)


def materialise(changes: DataFrame, table: KeyedTable, checkpoint: str, compact_every: int = 0, horizon: Callable[[], int | None] = lambda: None, refused: str | None = None, **trigger) -> StreamingQuery:
    """A stream of decoded changes kept as a table: inserts, updates and deletes, in any order, replayed or not.

    With ``compact_every`` the base is folded after every so many batches; it may as well be done by another job.  Changes older than the
    horizon go to the table at ``refused``, each batch under its own number.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            late = table.merge(batch, number)
            if refused:
                late.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(refused)
        finally:
            batch.unpersist()
        if compact_every and number % compact_every == compact_every - 1:
            table.compact(horizon())
            table.vacuum()

    return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def upsert_sink(rows: DataFrame, table: KeyedTable, checkpoint: str, compact_every: int = 0, **trigger) -> StreamingQuery:
    """The latest value of each key of an aggregation in update mode; ``table`` is ordered by ``("batch_no",)``."""

    def take(batch: DataFrame, number: int) -> None:
        table.merge(batch.withColumns({"batch_no": F.lit(number).cast("long"), "op": F.lit("u")}), number)
        if compact_every and number % compact_every == compact_every - 1:
            table.compact()
            table.vacuum()

    return rows.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


class CountedIngest:
    """JSON events to a table, with everything that is lost on the way in a dead-letter table and in counts.

    Timestamps are parsed strictly by ``ts_format``.  A record is malformed (no JSON object), bad_time (a timestamp column
    that is missing or does not parse) or late (older by more than ``delay_s`` than the newest event of the batches before);
    the others are valid.  Each batch is parsed once and writes ``outcome=valid`` and ``outcome=dead`` under its number, then
    its row of counts: as a replayed batch replaces all three, each record counts once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, ts: list[str], event_ts: str, delay_s: float = 30, ts_format: str = "yyyy-MM-dd HH:mm:ss.SSS"):
        self.spark, self.path, self.fields, self.ts, self.event_ts, self.delay_s, self.ts_format = spark, path.rstrip("/"), _fields(schema), ts, event_ts, delay_s, ts_format
        self.folder = Folder(spark, self.path)

    def counts(self) -> DataFrame:
        """(batch, messages, valid, malformed, bad_time, late, newest), a row a batch."""
        fields = "batch long, messages long, valid long, malformed long, bad_time long, late long, newest timestamp"
        return self.spark.read.schema(fields).parquet(f"{self.path}/counts") if self.folder.exists("counts") else self.spark.createDataFrame([], fields)

    def classified(self, raw: DataFrame, newest, column: str = "value") -> DataFrame:
        """The records of a batch: fields, ``raw`` and ``reason``; ``newest`` is the newest event time before this batch."""
        texts = T.StructType([T.StructField(f.name, T.StringType() if f.name in self.ts else f.dataType) for f in self.fields])
        text = F.col(column).cast("string")
        j = F.from_json(text, T.StructType([*texts.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
        rows = raw.select(text.alias("raw"), j.alias("_j"))
        value = lambda f: F.try_to_timestamp(F.col("_j")[f.name], F.lit(self.ts_format)).cast(f.dataType) if f.name in self.ts else F.col("_j")[f.name]
        rows = rows.select("raw", "_j", *[value(f).alias(f.name) for f in self.fields])
        bad_time = F.lit(False)
        for c in self.ts:
            bad_time = bad_time | F.col(c).isNull()
        late = F.lit(False) if newest is None else F.col(self.event_ts) < F.lit(newest) - F.make_dt_interval(secs=F.lit(self.delay_s))
        reason = F.when(F.col("_j").isNull() | F.col("_j._bad").isNotNull() | ~F.startswith(F.ltrim("raw"), F.lit("{")), "malformed").when(bad_time, "bad_time").when(late, "late")
        return rows.withColumn("reason", reason).drop("_j")

    def take(self, batch: DataFrame, number: int) -> None:
        newest = self.counts().where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        rows = self.classified(batch, newest)
        of = lambda r: F.count_if(F.col("reason") == r).alias(r)
        seen = Observation()
        fresh = F.max(F.when(F.col("reason").isNull(), F.col(self.event_ts)).cast("timestamp"))
        rows = rows.observe(seen, F.count(F.lit(1)).alias("messages"), F.count_if(F.col("reason").isNull()).alias("valid"), of("malformed"), of("bad_time"), of("late"), fresh.alias("newest"))
        out = rows.withColumns({"raw": F.when(F.col("reason").isNotNull(), F.col("raw")), "outcome": F.when(F.col("reason").isNull(), "valid").otherwise("dead"), "batch": F.lit(number).cast("long")})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("outcome", "batch").parquet(f"{self.path}/events")
        got = seen.get
        row = [(number, *(got[c] for c in ("messages", "valid", "malformed", "bad_time", "late", "newest")))]
        one = self.spark.createDataFrame(row, "batch long, messages long, valid long, malformed long, bad_time long, late long, newest timestamp")
        one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/counts")

    def _read(self, outcome: str) -> DataFrame:
        stored = T.StructType([T.StructField("raw", T.StringType()), *self.fields.fields, T.StructField("reason", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("batch", T.LongType())])
        rows = self.spark.read.schema(stored).parquet(f"{self.path}/events") if self.folder.exists("events") else self.spark.createDataFrame([], stored)
        done = self.counts().select("batch")  # a batch whose counts are not written yet will come again
        return rows.where(F.col("outcome") == outcome).join(F.broadcast(done), "batch", "left_semi")

    def events(self) -> DataFrame:
        return self._read("valid").select(*self.fields.names)

    def dead_letters(self) -> DataFrame:
        return self._read("dead").select("batch", "reason", "raw")

    def start(self, raw: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return raw.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


class WatermarkLosses(StreamingQueryListener):
    """Rows that stateful operators dropped behind their watermarks, by query and batch; a batch that is reported again counts once."""

    def __init__(self) -> None:
        self.by_batch: dict[tuple[str, int], int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.by_batch[str(p.id), p.batchId] = max(self.by_batch.get((str(p.id), p.batchId), 0), sum(s.numRowsDroppedByWatermark for s in p.stateOperators))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def rows(self, spark: SparkSession) -> DataFrame:
        """(query, batch, dropped)."""
        return spark.createDataFrame([(q, b, n) for (q, b), n in self.by_batch.items()], "query string, batch long, dropped long")
