"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run without ASCII white space.  ``bytes.split()``
#: splits on exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of texts that a Python worker gets at a time while a table is written: tens of megabytes, not hundreds.
ARROW_ROWS = 2_000

_own_root: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, as in tests on one machine, a folder of this
    process is used; on a cluster that raises, as executors would not see it.
    """
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="tallyweir-")
    return f"file://{_own_root}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver ends."""
    path = f"{shared_root(spark)}/tallyweir/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` cut from its lineage: a Parquet table in the shared folder, read back.

    Losing an executor afterwards costs a re-read of files, not a re-run.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, str(min(int(before), ARROW_ROWS) if int(before) > 0 else ARROW_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(rows, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from ``written`` that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as ''."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(n)


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
