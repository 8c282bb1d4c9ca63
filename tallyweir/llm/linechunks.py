"""Line deduplication over content-defined chunks of lines.

A text is split at ``\\n``.  Every line has a hash, and a rolling hash runs over
each line's hash and its predecessor's; a chunk ends where the rolling hash is a
multiple of ``divisor`` and the place before was no such end, so that ends
depend on the lines around them alone and move along with inserted text, and
every chunk but a text's last has two lines or more.  Chunks of two lines or
more, of which one at least holds a word (the others may be blank, as between
paragraphs), are compared across the whole corpus: by a 64-bit hash first, and those whose hash occurs again byte by byte.  The first place (by
document id, then line, then a hash of the text) keeps a repeated chunk, the
others lose it.

Null texts have no lines and stay null; an empty text is one empty line.  Rows
of equal id and text are one document and share its result; a null id sorts
before all others.  Empty tables give empty results.  Only the columns named
are read, other columns pass through whatever their names, but for ``_n_lines``
and ``_n_removed``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm.common import table, written

#: A chunk end is expected about every ``DIVISOR + 1`` lines.
DIVISOR = 3
_BASE, _MODULUS = 1_000_003, 2_147_483_647


def _shifted(values, first):
    """The array moved one place on, with ``first`` at its start."""
    return F.concat(F.array(first), F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))))


def _chunks(docs: DataFrame, divisor: int) -> DataFrame:
    """(_id, _t, _start, _end, _chunk): chunks that may be removed, ends exclusive."""
    rows = docs.where(F.col("_text").isNotNull()).select("_id", "_t", F.split("_text", "\n", -1).alias("_lines"))
    rows = rows.withColumn("_h", F.transform("_lines", lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long")))
    rows = rows.withColumn(
        "_b", F.zip_with("_h", _shifted(F.col("_h"), F.lit(0).cast("long")), lambda x, y: (x + y * _BASE) % _MODULUS % divisor == 0)
    )
    rows = rows.withColumn("_n", F.size("_lines"))
    cut = F.zip_with("_b", _shifted(F.col("_b"), F.lit(False)), lambda x, y: x & ~y)
    rows = rows.withColumn(
        "_ends", F.filter(F.transform(cut, lambda x, i: F.when(x | (i == F.col("_n") - 1), i + 1)), lambda x: x.isNotNull())
    )
    rows = rows.select("_id", "_t", "_lines", F.explode(F.arrays_zip(_shifted(F.col("_ends"), F.lit(0)).alias("s"), F.col("_ends").alias("e"))).alias("_c"))
    part = F.slice("_lines", F.col("_c.s") + 1, F.col("_c.e") - F.col("_c.s"))
    rows = rows.where(F.col("_c.e") - F.col("_c.s") >= 2).select("_id", "_t", F.col("_c.s").alias("_start"), F.col("_c.e").alias("_end"), part.alias("_part"))
    worded = F.exists("_part", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.where(worded).select("_id", "_t", "_start", "_end", F.xxhash64(F.array_join("_part", "\n")).alias("_key"))


def repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """(_id, _t, _ranges): the line ranges that each document loses; _t is a hash of its text."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))
    chunks = _chunks(rows, divisor)
    again = written(chunks.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key"), "line-keys")
    ranges = chunks.join(again, "_key", "left_semi").groupBy("_id", "_t").agg(F.collect_set(F.struct("_start", "_end")).alias("_of"))
    ranges = ranges.withColumnsRenamed({"_id": "_with_id", "_t": "_with_t"})
    # texts meet the few ranges by a merge join at every size: they are the large side, and grow with the corpus
    match = F.col("_with_id").eqNullSafe(F.col("_id")) & (F.col("_with_t") == F.col("_t"))
    candidates = rows.join(ranges.hint("merge"), match).select("_id", "_t", "_text", F.explode("_of").alias("_c"))
    part = F.slice(F.split("_text", "\n", -1), F.col("_c._start") + 1, F.col("_c._end") - F.col("_c._start"))
    candidates = written(candidates.select("_id", "_t", "_c.*", F.array_join(part, "\n").alias("_chunk")), "line-chunks")
    place = F.struct("_id", "_start", "_t")
    first = candidates.groupBy("_chunk").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first != _last")
    first = written(first.drop("_last"), "line-firsts")
    lost = candidates.join(first, "_chunk").where(~place.eqNullSafe(F.col("_first")))
    return lost.groupBy("_id", "_t").agg(F.collect_set(F.struct("_start", "_end")).alias("_ranges"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """``docs`` with ``text`` rid of repeated chunks, and ``_n_lines``, ``_n_removed``."""
    lost = repeated_chunks(docs, doc_id, text, divisor).select(F.col("_id").alias("_lost_id"), F.col("_t").alias("_lost_t"), "_ranges")
    # whatever the columns are called, inside a struct they clash with none of these
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("_row"), docs[doc_id].alias("_id"), docs[text].alias("_text"))
    match = F.col("_lost_id").eqNullSafe(F.col("_id")) & (F.col("_lost_t") == F.xxhash64("_text"))
    rows = rows.join(lost.hint("merge"), match, "left").withColumn("_lines", F.split("_text", "\n", -1))
    kept = F.filter("_lines", lambda x, i: ~F.exists("_ranges", lambda r: (i >= r["_start"]) & (i < r["_end"])))
    rows = rows.withColumn("_kept", F.when(F.col("_ranges").isNull(), F.col("_lines")).otherwise(kept))
    n = F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long")
    removed = F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_kept")).cast("long")
    columns = [F.array_join("_kept", "\n").alias(text) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("_n_lines", "_n_removed")]
    return rows.select(*columns, n.alias("_n_lines"), removed.alias("_n_removed"))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
r AS (SELECT *, (h + {_BASE} * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % {_MODULUS} % {DIVISOR} = 0 AS b FROM h),
c AS (SELECT *, b AND NOT coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY i), false) AS cut FROM r),
k AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM c),
g AS (SELECT doc_id, chunk, min(i) AS s, count(*) AS n, sum(regexp_matches(line, '[^\\x20\\x09-\\x0D]')::INT) AS worded,
        string_agg(line, chr(10) ORDER BY i) AS t FROM k GROUP BY doc_id, chunk),
e AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) > 1 AS lost FROM g WHERE n >= 2 AND worded >= 1),
m AS (SELECT k.doc_id, k.i, k.line, coalesce(e.lost, false) AS lost FROM k LEFT JOIN e ON k.doc_id = e.doc_id AND k.chunk = e.chunk),
o AS (SELECT doc_id, count(*) AS n_lines, sum(lost::INT)::BIGINT AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed, 0) AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
