"""Files in a temporary folder: contracts, slices, landing, encodings."""

import gzip

import pytest
from pyspark.sql import functions as F

from tallyweir.sources import storage as st

DDL = "user_id string, page_type int, date string, hour int, second int"


@pytest.fixture()
def csv(tmp_path):
    with gzip.open(tmp_path / "in.csv.gz", "wt") as f:
        f.write("user_id,page_type,date,hour,second\nu1,1,2026-01-01,10,1\nu2,x,2026-01-01,10,2\n,1,2026-01-01,10,3\nu3,2,2026-01-02,11,4\n")
    return str(tmp_path / "in.csv.gz")


def test_contract_splits_every_row(spark, csv):
    rows = st.scan_csv(spark, csv, DDL)
    good, bad = st.split_on_contract(rows, ["user_id"])
    assert sorted(r.user_id for r in good.collect()) == ["u1", "u3"]
    assert sorted(r[st.CORRUPT] or "" for r in bad.collect()) == ["", "u2,x,2026-01-01,10,2"]
    assert st.scan_csv(spark, csv).columns == ["user_id", "page_type", "date", "hour", "second"]


def test_slices_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    assert st.scan_partitioned(spark, path, DDL).count() == 0
    rows = spark.createDataFrame([("u1", 1, "2026-01-01", 10, 1), ("u2", 2, "2026-01-01", 10, 2)], DDL)
    for _ in range(2):
        st.write_partitioned(rows, path)
    assert st.scan_partitioned(spark, path, DDL).count() == 2
    new = spark.createDataFrame([("u9", 1, "2026-01-01", 10, 9), ("u8", 2, "2026-01-01", 10, 8)], DDL)
    assert st.replace_slice(new, path, 1, "2026-01-01", 10) == 1
    assert sorted(r.user_id for r in st.scan_partitioned(spark, path, DDL).collect()) == ["u2", "u9"]
    assert st.replace_slice(new, path, 9, "2026-01-01", 10) == 0
    assert {r.page_type for r in st.scan_partitioned(spark, path).select("page_type").collect()} <= {"1", "2", "3"}  # texts without a schema
    stats = st.file_stats(spark.read.parquet(path)).first()
    assert (stats.files, stats.records) == (2, 2) and stats.bytes > 0
    st.compact(spark, path, str(tmp_path / "c"), live=F.col("user_id") != "u9")
    assert [r.user_id for r in st.scan_partitioned(spark, str(tmp_path / "c"), DDL).collect()] == ["u2"]


def test_landing_publishes_last(spark, csv, tmp_path):
    table, bad, manifest = (str(tmp_path / x) for x in ("t", "q", "m"))
    rows = st.scan_csv(spark, csv, DDL)
    with pytest.raises(ValueError):
        st.land_slice(rows, ["user_id"], table, bad, manifest, "j1")
    assert not (tmp_path / "m").exists() and not (tmp_path / "t").exists()
    st.land_slice(rows, ["user_id"], table, bad, manifest, "j2", max_bad=0.5)
    assert sorted(r.rows_written for r in spark.read.json(manifest).collect()) == [1, 1]
    assert st.read_quarantine(spark, bad).groupBy("run_id").count().count() == 1  # the first run wrote nothing


def test_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\n".encode())
    (tmp_path / "b.txt").write_bytes(b"ok\n\xff\xfe\n")
    assert {r.file[-5:]: r.valid_utf8 for r in st.check_utf8(spark, str(tmp_path)).collect()} == {"a.txt": True, "b.txt": False}
