"""Reads and writes of event tables: contract CSV, partitioned Parquet, quarantine, landing."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITIONS = ("page_type", "date", "hour")
CORRUPT = "_corrupt_record"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
    """Delimited text, compressed or not. With a schema, bad rows keep their raw text in ``_corrupt_record``."""
    options: dict = {"header": header, "inferSchema": schema is None}
    if schema is not None:
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(schema.fields)
        kept = fields if CORRUPT in fields.names else fields.add(CORRUPT, T.StringType())
        options |= {"schema": kept, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return spark.read.load(path, format="csv", **options)


def contract_holds(required: list[str], columns: list[str]) -> Column:
    """Not corrupt, and no required column is null."""
    whole = [F.col(CORRUPT).isNull()] if CORRUPT in columns else []
    return functools.reduce(lambda a, b: a & b, [*whole, *(F.col(c).isNotNull() for c in required)], F.lit(True))


def split_on_contract(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the corrupt column, the others); each row is in exactly one."""
    ok = contract_holds(required, rows.columns)
    return rows.where(ok).drop(CORRUPT), rows.where(~ok)


def scan_partitioned(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A partitioned table, partition values as texts; with a schema (partition columns included) typed, and also where nothing is stored yet."""
    if schema is None:
        rows = spark.read.parquet(path)
        named = [c for c in rows.columns if f"/{c}=" in next(iter(rows.inputFiles()), "")]
        if not named:
            return rows
        # read again with the partition values as they are written, texts
        return spark.read.schema(T.StructType([T.StructField(f.name, T.StringType() if f.name in named else f.dataType) for f in rows.schema])).parquet(path)
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).parquet(path).select(*fields.names)


def write_partitioned(rows: DataFrame, path: str, partitions: tuple[str, ...] = PARTITIONS, files_each: int = 1) -> None:
    """Overwrites only the partitions in ``rows``; a rerun changes nothing.

    ``files_each`` over 1 spreads a large partition over as many files.
    """
    keys = [F.col(c) for c in partitions]
    if files_each > 1:
        keys.append(F.pmod(F.xxhash64(*[c for c in rows.columns if c not in partitions]), F.lit(files_each)))
    rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*partitions).parquet(path)


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, in whatever store it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def replace_slice(rows: DataFrame, path: str, page_type: int, date: str, hour: int) -> int:
    """Replaces one slice by the rows of it in ``rows``; gives how many there are. Without any the old slice is deleted."""
    spark = rows.sparkSession
    part = rows.where((F.col("page_type") == page_type) & (F.col("date") == date) & (F.col("hour") == hour))
    folder = f"{path}/page_type={page_type}/date={date}/hour={hour}"
    if part.isEmpty():
        fs, p = _folder(spark, folder)
        fs.delete(p, True)
        return 0
    write_partitioned(part, path)
    return spark.read.parquet(folder).count()  # from the footers


def write_quarantine(rows: DataFrame, path: str, source_path: str, run_id: str) -> None:
    told = {"source_path": F.lit(source_path), "run_id": F.lit(run_id), "quarantined_at": F.current_timestamp()}
    rows.withColumns(told).write.mode("append").parquet(path)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def land_slice(rows: DataFrame, required: list[str], table_path: str, quarantine_path: str, manifest_path: str, job_id: str, max_bad: float = 0.01) -> DataFrame:
    """Checks rows, writes the valid ones and the rejected ones, then publishes counts by slice as the last step.

    Over ``max_bad`` rejected in all raises before anything is written, so that a retry repeats nothing.
    """
    ok = contract_holds(required, rows.columns)
    rows = rows.persist()
    try:
        counts = rows.groupBy(*PARTITIONS).agg(F.count("*").alias("rows_read"), F.count_if(ok).alias("rows_written"), F.count_if(~ok).alias("rows_quarantined"))
        n, bad = counts.agg(F.sum("rows_read"), F.sum("rows_quarantined")).first()
        if n and bad / n > max_bad:
            raise ValueError(f"{bad} of {n} rows break the contract")
        valid, rejected = split_on_contract(rows, required)
        write_quarantine(rejected, quarantine_path, table_path, job_id)
        write_partitioned(valid, table_path)
        counts = counts.where("rows_written > 0").withColumn("job_id", F.lit(job_id))
        counts.coalesce(1).write.mode("append").json(manifest_path)
        return rows.sparkSession.createDataFrame(counts.collect(), counts.schema)  # one row a slice
    finally:
        rows.unpersist()


def file_stats(rows: DataFrame) -> DataFrame:
    """One row: files, records and bytes of a table read from files."""
    each = rows.groupBy(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size")).agg(F.count("*").alias("_n"))
    return each.agg(F.count("*").alias("files"), F.sum("_n").alias("records"), F.sum("_size").alias("bytes"), F.avg("_size").alias("average_file_bytes"))


def compact(spark: SparkSession, source: str, target: str, partitions: tuple[str, ...] = PARTITIONS, live: Column | None = None) -> None:
    """Writes the live rows of many small files as one file a partition."""
    rows = spark.read.parquet(source)
    write_partitioned(rows if live is None else rows.where(live), target, partitions)


def check_utf8(spark: SparkSession, path: str) -> DataFrame:
    """(file, valid_utf8) of text files, compressed or not."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("_ok"))
    return lines.groupBy("file").agg(F.bool_and("_ok").alias("valid_utf8"))


def partition_stats(rows: DataFrame, partitions: tuple[str, ...] = PARTITIONS) -> DataFrame:
    """Records and files of each partition of a table read from files, largest first."""
    each = rows.groupBy(*partitions, F.col("_metadata.file_path").alias("_path")).agg(F.count("*").alias("_n"))
    return each.groupBy(*partitions).agg(F.sum("_n").alias("records"), F.count("*").alias("files")).orderBy(F.desc("records"), *partitions)


def write_clustered(rows: DataFrame, path: str, tenant: str, ts: str, lookup: str, files: int = 8) -> None:
    """By month, and within it sorted by tenant and time, with Bloom filters for a column that is looked up by value."""
    month = rows.withColumn("month", F.date_format(ts, "yyyy-MM"))
    ordered = month.repartitionByRange(files, "month", tenant, ts).sortWithinPartitions("month", tenant, ts)
    ordered.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{lookup}", "true").option("compression", "zstd").partitionBy("month").parquet(path)


def write_second_copy(rows: DataFrame, path: str, by: list[str], files: int = 8) -> None:
    """The same rows in another order, for readers that choose it."""
    rows.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_layouts(*layouts: tuple[DataFrame, tuple[str, ...]]) -> DataFrame:
    """One table of roots that are partitioned differently; each goes with the names of its derived partition columns.

    Filters on either kind of column reach the scan of the root that has it.
    """
    return functools.reduce(DataFrame.unionByName, [rows.drop(*derived) for rows, derived in layouts])
