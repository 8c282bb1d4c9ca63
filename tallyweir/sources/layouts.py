"""Tables of several roots, each partitioned its own way, read by one filter that prunes all of them."""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.sources.shared import Folder


@dataclass(frozen=True)
class Transform:
    """How a partition column comes from a column: identity, year, month, day, hour, truncate (to ``n`` characters) or bucket (of ``n``)."""

    source: str
    kind: str = "identity"
    n: int = 0

    @property
    def name(self) -> str:
        return self.source if self.kind == "identity" else f"{self.source}_{self.kind}"

    @property
    def ordered(self) -> bool:
        """Whether a greater value never comes to a smaller partition."""
        return self.kind != "bucket"

    def of(self, value: Column) -> Column:
        """The partition of a value, null for null: a text or a number that folders are called by."""
        if self.kind == "identity":
            return value
        if self.kind == "bucket":
            return F.when(value.isNotNull(), F.pmod(F.xxhash64(value), F.lit(self.n)).cast("int"))
        if self.kind == "truncate":
            return F.substring(value, 1, self.n)
        formats = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH"}
        if self.kind not in formats:
            raise ValueError(f"no transform is called {self.kind}")
        return F.date_format(value, formats[self.kind])

    def stored(self, source: T.DataType) -> T.DataType:
        return source if self.kind == "identity" else T.IntegerType() if self.kind == "bucket" else T.StringType()


@dataclass(frozen=True)
class Is:
    """A condition on one column: ``=``, ``in``, ``<``, ``<=``, ``>``, ``>=`` or ``null``. Several are all to hold."""

    column: str
    op: str
    value: Any = None

    def on(self, column: Column, kind: T.DataType) -> Column:
        lit = lambda v: F.lit(v).cast(kind)
        if self.op == "null":
            return column.isNull()
        if self.op == "in":
            return column.isin(*map(lit, self.value))
        tests = {"=": column.__eq__, "<": column.__lt__, "<=": column.__le__, ">": column.__gt__, ">=": column.__ge__}
        if self.op not in tests:
            raise ValueError(f"no condition is called {self.op}")
        return tests[self.op](lit(self.value))

    def over(self, transform: Transform, kind: T.DataType) -> Column | None:
        """What the condition says of the partition column: true wherever the condition is; None if nothing."""
        part, to = F.col(transform.name), lambda v: transform.of(F.lit(v).cast(kind))
        if self.op == "null":
            return part.isNull()
        if transform.kind == "identity":
            return self.on(part, kind)
        if self.op in ("=", "in"):
            return part.isin(*[to(v) for v in (self.value if self.op == "in" else [self.value])])
        if not transform.ordered:
            return None
        return part >= to(self.value) if self.op in (">", ">=") else part <= to(self.value)  # the bound's own partition holds both sides of it


@dataclass(frozen=True)
class Layout:
    """A root and how it is partitioned."""

    path: str
    transforms: tuple[Transform, ...]

    def write(self, rows: DataFrame, mode: str = "overwrite") -> None:
        """Rows under this layout; only the partitions in ``rows`` are replaced, one file each."""
        derived = {t.name: t.of(F.col(t.source)) for t in self.transforms if t.kind != "identity"}
        keys = [t.name for t in self.transforms]
        rows.withColumns(derived).repartition(*keys).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(self.path)

    def read(self, spark: SparkSession, schema: T.StructType, where: tuple[Is, ...] = ()) -> DataFrame:
        """Rows that meet the conditions; each also goes to the partition columns that come from its column."""
        kinds = {f.name: f.dataType for f in schema.fields}
        parts = [T.StructField(t.name, t.stored(kinds[t.source])) for t in self.transforms]
        names = {p.name for p in parts}
        rows = spark.read.schema(T.StructType([*(f for f in schema.fields if f.name not in names), *parts])).parquet(self.path)
        for one in where:
            rows = rows.where(one.on(F.col(one.column), kinds[one.column]))
            for t in self.transforms:
                test = one.over(t, kinds[t.source]) if t.source == one.column and t.kind != "identity" else None
                rows = rows if test is None else rows.where(test)
        return rows.select(*schema.names)


def read_table(spark: SparkSession, layouts: list[Layout], schema: T.StructType | str, where: tuple[Is, ...] = ()) -> DataFrame:
    """One table of all roots under the same conditions. A change of layout is a new root for new rows; old files stay as they are."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if missing := {w.column for w in where} - set(fields.names):
        raise ValueError(f"no column is called {sorted(missing)}")
    return functools.reduce(DataFrame.unionByName, [x.read(spark, fields, where) for x in layouts])


def expire(spark: SparkSession, layout: Layout, schema: T.StructType | str, column: str, before) -> dict[str, int]:
    """Retention: rows whose ``column`` is smaller than ``before`` go from a layout that is partitioned by an ordered transform of it.

    Partitions that lie wholly before it are deleted as folders, without reading them; of the one that holds ``before`` the
    rows that stay are written anew, aside first, so that a failure loses nothing.  Rows without a value stay.
    Gives how many partitions were ``dropped`` and ``rewritten``.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    by = next((t for t in layout.transforms if t.source == column and t.ordered), None)
    if by is None or layout.transforms[0] != by:
        raise ValueError(f"the first partition column of {layout.path} does not follow the order of {column}")
    kind = next(f.dataType for f in fields.fields if f.name == column)
    edge = spark.range(1).select(by.of(F.lit(before).cast(kind)).cast("string")).first()[0]
    folder, done = Folder(spark, layout.path), {"dropped": 0, "rewritten": 0}
    for name in folder.names():
        value = name.removeprefix(f"{by.name}=")
        if not name.startswith(f"{by.name}=") or value == "__HIVE_DEFAULT_PARTITION__" or value > edge:
            continue
        if value == edge and by.kind != "identity":
            rest = layout.read(spark, fields, (Is(column, ">=", before),)).where(by.of(F.col(column)) == edge)
            aside = Layout(f"{layout.path}/_expire", layout.transforms)
            aside.write(rest)
            folder.delete(name)
            if folder.exists(f"_expire/{name}"):
                folder.rename(f"_expire/{name}", name)
            folder.delete("_expire")
            done["rewritten"] += 1
        elif value < edge:
            folder.delete(name)
            done["dropped"] += 1
    return done


def files_read(rows: DataFrame) -> list[tuple[str, int]]:
    """(partition filters, files) of each scan of the plan that runs, from its metrics; runs the query."""
    rows.write.format("noop").mode("overwrite").save()
    plan = rows._jdf.queryExecution().executedPlan()
    rows.collect()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, out = plan.collectLeaves(), []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if "FileSourceScan" in leaf.getClass().getSimpleName():
            out.append((leaf.partitionFilters().mkString(" "), leaf.metrics().apply("numFiles").value()))
    return out
