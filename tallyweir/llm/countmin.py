"""Removal of long repeated passages, with a count-min prefilter.

A window is ``window`` consecutive words of one document.  Words covered by a
window that also starts in a document with a smaller id are removed.

Pass 1 fills a count-min sketch (see ``sketch``).  Every window stands for its
least-hashed run of ``GRAM`` words; equal windows have equal least runs, so that
counting those runs overestimates the count of every window and loses none, with
a fifth of the entries.  Pass 2 looks up every window; those estimated repeated
are grouped exactly, the others never leave their task.

Neighbouring suspect windows travel together: runs of them are cut where a
window's hash says so, which makes equal passages fall into equal segments, and
a segment is one row with a 128-bit hash of its own.  Of equal segments only the
one in the smallest document hands its windows (64-bit hashes) to the grouping;
every other holder of the segment loses all its windows at once.

Null and empty texts have no words.  A row with a null id loses nothing and
takes nothing from others.  Rows of equal id take nothing from each other.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.llm.common import table, written
from tallyweir.llm.sketch import Bitmap, sketch
from tallyweir.llm.wordhash import WordHasher, pieces, run_documents, run_hashes, second_run_hashes, sliding_min, table_map

WINDOW, GRAM = 50, 42
#: A segment of suspect windows ends at every window whose hash is a multiple of this, on average.
SEGMENT = 32


def _least(h: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, documents, hash of the least run) of all windows."""
    places, doc = run_documents(ends, window)
    gram = max(1, window * GRAM // WINDOW)
    if not len(places):
        return places, doc, np.zeros(0, dtype=np.uint64)
    return places, doc, sliding_min(run_hashes(h, gram), window - gram + 1)[places]


def _entries(window: int):
    def run(batches):
        hasher = WordHasher()
        for _, h, ends in pieces(batches, hasher):
            _, doc, least = _least(h, ends, window)
            if len(least):  # neighbours that share a least run count once
                yield least[np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))]

    return run


def _segments(window: int, bitmap: Bitmap):
    def run(batches):
        hasher = WordHasher()
        for batch, h, ends in pieces(batches, hasher):
            places, doc, least = _least(h, ends, window)
            k = np.flatnonzero(bitmap.hits(least)) if len(least) else []
            if not len(k):
                continue
            a, b = run_hashes(h, window)[places[k]], second_run_hashes(h, window)[places[k]]
            cut = np.ones(len(k), dtype=bool)
            cut[1:] = (np.diff(k) != 1) | (doc[k][1:] != doc[k][:-1]) | (a[:-1] % np.uint64(SEGMENT) == 0)
            first = np.flatnonzero(cut)
            length = np.diff(np.append(first, len(k)))
            with np.errstate(over="ignore"):  # sums over the windows' hashes, each mixed with its place in the segment
                turn = (np.arange(len(k)) - np.repeat(first, length)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                sa = np.add.reduceat((a ^ turn) * np.uint64(0xBF58476D1CE4E5B9), first)
                sb = np.add.reduceat((b + turn) * np.uint64(0x94D049BB133111EB), first)
            home = doc[k][first]
            ids, hashes = batch.column("_id"), batch.column("_t")
            windows = a.view(np.int64)
            for s in range(0, len(first), 50_000):
                e = slice(s, s + 50_000)
                edge = np.append(first[e], first[e][-1] + length[e][-1])
                yield {
                    "_id": ids.take(pa.array(home[e])),
                    "_t": hashes.take(pa.array(home[e])),
                    "_a": pa.array(sa[e].view(np.int64)),
                    "_b": pa.array(sb[e].view(np.int64)),
                    "_at": pa.array((places[k][first[e]] - ends[home[e]]).astype(np.int32)),
                    "_w": pa.ListArray.from_arrays(pa.array((edge - edge[0]).astype(np.int32)), pa.array(windows[edge[0] : edge[-1]])),
                }

    return table_map(run)


def _marker(window: int):
    def run(batches):
        for batch in batches:
            texts, lost = batch.column("_text"), batch.column("_lost")
            n, gone, kept = [], [], []
            for k in range(len(texts)):
                words = (texts[k].as_py() or "").encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                if not lost[k].is_valid:
                    gone.append(0)
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                    continue
                spans = lost[k].values
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, spans.field("at").to_numpy(), 1)
                np.add.at(edge, spans.field("at").to_numpy() + spans.field("n").to_numpy() + window - 1, -1)
                keep = np.cumsum(edge[:-1]) == 0
                gone.append(int(len(words) - keep.sum()))
                kept.append(b" ".join(w for w, x in zip(words, keep.tolist(), strict=True) if x).decode("utf-8", "surrogatepass"))
            yield {"_id": batch.column("_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.string())}

    return table_map(run)


def lost_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_id, _t, _lost): first window and number of windows of each lost run; rows has _id, _t, _text."""
    kind = rows.schema["_id"].dataType
    characters = rows.agg(F.sum(F.length("_text"))).first()[0] or 0
    gram = max(1, window * GRAM // WINDOW)
    bitmap = sketch(rows.select("_text"), _entries(window), characters / 6 * 2 / (window - gram + 2))
    long, int_ = T.LongType(), T.IntegerType()
    schema = T.StructType([T.StructField("_id", kind), *(T.StructField(c, long) for c in ("_t", "_a", "_b")), T.StructField("_at", int_), T.StructField("_w", T.ArrayType(long))])
    held = written(rows.where("_id is not null").mapInArrow(_segments(window, bitmap), schema), "segments")
    bitmap.close()
    owners = written(held.groupBy("_a", "_b").agg(F.min("_id").alias("_first")), "segment-owners")
    # merge joins at every size: held segments grow with the corpus, and a hot segment can be split
    met = held.join(owners.hint("merge"), ["_a", "_b"])
    span = F.struct(F.col("_at").alias("at"), F.size("_w").alias("n"))
    met = written(met.select("_id", "_t", span.alias("_span"), F.when(F.col("_id") == F.col("_first"), F.col("_w")).alias("_w")), "met-segments")
    own = met.where("_w is not null").select("_id", "_t", F.col("_span.at").alias("_from"), F.posexplode("_w").alias("_k", "_x"))
    least = own.groupBy("_x").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).where("_least < _most").drop("_most")
    least = written(least, "window-owners")
    late = own.join(least.hint("merge"), "_x").where("_id > _least")
    late = late.select("_id", "_t", F.struct((F.col("_from") + F.col("_k")).cast("int").alias("at"), F.lit(1).alias("n")).alias("_span"))
    lost = met.where("_w is null").select("_id", "_t", "_span").unionByName(late)
    return lost.groupBy("_id", "_t").agg(F.collect_set("_span").alias("_lost"))  # repeated rows of one id lose the same


def remove_repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(``doc_id``, n_words, n_removed, kept): kept words joined by one space, for each row."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))
    lost = lost_spans(rows, window).withColumnsRenamed({"_id": "_with", "_t": "_with_t"})
    match = (F.col("_id") == F.col("_with")) & (F.col("_t") == F.col("_with_t"))
    marked = rows.join(lost.hint("merge"), match, "left").select("_id", "_text", "_lost")
    out = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return marked.mapInArrow(_marker(window), out).withColumnRenamed("_id", doc_id)


def op5_countmin_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same rows from a plain dictionary of windows; for small inputs."""
    first: dict[tuple, int] = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
