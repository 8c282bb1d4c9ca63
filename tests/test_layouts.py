"""One filter over roots with different layouts: same rows as the plain table, and few files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweir.sources.layouts import Is, Layout, Transform, expire, files_read, read_table

SCHEMA = "user_id string, date date, n int"
DAY = dt.date(2026, 1, 1)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("layouts")
    rows = [(f"u{k % 40}" if k % 50 else None, DAY + dt.timedelta(days=k % 365) if k % 70 else None, k) for k in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    old = Layout(str(root / "old"), (Transform("date", "month"),))
    new = Layout(str(root / "new"), (Transform("user_id", "bucket", 8), Transform("date", "year")))
    third = Layout(str(root / "third"), (Transform("date"), Transform("user_id", "truncate", 2)))
    for k, layout in enumerate((old, new, third)):
        layout.write(df.where(F.col("n") % 3 == k))
    return rows, [old, new, third]


def _holds(w, value):
    if w.op == "null":
        return value is None
    if value is None:
        return False
    return {"=": lambda: value == w.value, "in": lambda: value in w.value, "<": lambda: value < w.value, "<=": lambda: value <= w.value, ">": lambda: value > w.value, ">=": lambda: value >= w.value}[w.op]()


@pytest.mark.parametrize(
    "where",
    [
        (), (Is("date", "=", dt.date(2026, 3, 31)),), (Is("date", ">", dt.date(2026, 3, 31)), Is("date", "<=", dt.date(2026, 4, 1))), (Is("date", ">=", dt.date(2026, 12, 1)),),
        (Is("date", "<", dt.date(2026, 2, 1)),), (Is("user_id", "=", "u7"),), (Is("user_id", "in", ["u7", "u8", "nobody"]), Is("date", "<", dt.date(2026, 6, 15))), (Is("date", "null"),), (Is("user_id", "null"),),
        (Is("user_id", ">=", "u35"),), (Is("date", "in", [dt.date(2026, 5, 5), dt.date(2026, 7, 7)]), Is("n", ">", 500)),
    ],
)
def test_rows_are_those_of_the_plain_table(spark, both, where):
    rows, layouts = both
    expected = [r for r in rows if all(_holds(w, dict(zip(("user_id", "date", "n"), r, strict=True))[w.column]) for w in where)]
    assert sorted(map(tuple, read_table(spark, layouts, SCHEMA, where).collect()), key=str) == sorted(expected, key=str)


def test_each_root_is_pruned_by_the_same_filter(spark, both):
    _, (old, new, third) = both
    found = files_read(read_table(spark, [old, new, third], SCHEMA, (Is("date", "=", dt.date(2026, 3, 5)), Is("user_id", "=", "u7"))))
    assert len(found) == 3 and all(filters for filters, _ in found)
    by_root = [("date_month", 1), ("user_id_bucket", 1), ("user_id_truncate", 1)]
    for (filters, files), (column, most) in zip(found, by_root, strict=True):
        assert column in filters and files <= most
    everything = [files for _, files in files_read(read_table(spark, [old, new, third], SCHEMA))]
    assert everything[0] == 13 and everything[1] >= 9 and everything[2] > 300
    months = files_read(read_table(spark, [old], SCHEMA, (Is("date", ">", dt.date(2026, 2, 10)), Is("date", "<", dt.date(2026, 4, 2)))))
    assert months[0][1] == 3
    # a bucket says nothing of an order: all its files are read
    assert files_read(read_table(spark, [new], SCHEMA, (Is("user_id", ">", "u7"),)))[0][1] >= 9


def test_unknown_names_raise(spark, both):
    for wrong in (lambda: read_table(spark, both[1], SCHEMA, (Is("nope", "=", 1),)), lambda: Transform("date", "week").of(F.lit(DAY)), lambda: read_table(spark, both[1], SCHEMA, (Is("n", "~", 1),))):
        with pytest.raises(ValueError):
            wrong()


def test_old_partitions_are_dropped_and_the_edge_is_rewritten(spark, tmp_path):
    rows = [(f"u{k % 4}", DAY + dt.timedelta(days=k) if k % 11 else None, k) for k in range(300)]
    layout, edge = Layout(str(tmp_path / "t"), (Transform("date", "month"), Transform("user_id"))), dt.date(2026, 5, 10)
    layout.write(spark.createDataFrame(rows, SCHEMA))
    assert expire(spark, layout, SCHEMA, "date", edge) == {"dropped": 4, "rewritten": 1}
    left = sorted((tuple(r) for r in layout.read(spark, read_table(spark, [layout], SCHEMA).schema).collect()), key=str)
    assert left == sorted((r for r in rows if r[1] is None or r[1] >= edge), key=str)
    assert expire(spark, layout, SCHEMA, "date", edge) == {"dropped": 0, "rewritten": 1} and not (tmp_path / "t" / "_expire").exists()
    daily = Layout(str(tmp_path / "d"), (Transform("date"),))
    daily.write(spark.createDataFrame(rows, SCHEMA))
    gone = len({r[1] for r in rows if r[1] and r[1] < edge})
    assert expire(spark, daily, SCHEMA, "date", edge) == {"dropped": gone, "rewritten": 0}
    with pytest.raises(ValueError):
        expire(spark, Layout(str(tmp_path / "t"), (Transform("user_id", "bucket", 4),)), SCHEMA, "date", edge)
