"""Texts of timestamps in years of more than four digits and before year 1, as SQL writes them."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tallyweir.functions import scalars as sc

#: Order keys on both sides of years 10000, 1 and 0, of four and five digits before year 1, and the last that fit.
KEYS = [0, 1, -1, 2_932_930, 2_932_931, 8_999_999, 106_753_226, -719_000, -719_170, -719_171, -719_530, -719_540, -720_000, -4_000_000, -8_000_000, -106_000_000, None]


def test_query_equals_its_sql(spark, tmp_path):
    rows = [(k, None if k is None else k * 7 % 900_000, "O", 1.0, datetime.datetime(1996, 1, 2), "5-LOW") for k in KEYS] + [(2_932_931, -19_999, "F", 1.0, None, None)]
    kind = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    expected = c.execute(oracle_sql()["p10_epoch_convert"]).fetchall()
    found = [tuple(r) for r in queries()["p10_epoch_convert"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert len(found) == len(KEYS) + 1


@pytest.mark.parametrize(
    ("millis", "text"),
    [
        (0, "1970-01-01 00:00:00"), (1_010, "1970-01-01 00:00:01.01"), (-1, "1969-12-31 23:59:59.999"), (253_402_300_799_999, "9999-12-31 23:59:59.999"),
        (253_402_300_800_000, "10000-01-01 00:00:00"), (9_223_372_036_854_775, "294247-01-10 04:00:54.775"), (-62_135_596_800_000, "0001-01-01 00:00:00"),
        (-62_135_596_800_001, "0001-12-31 (BC) 23:59:59.999"), (-62_167_219_200_001, "0002-12-31 (BC) 23:59:59.999"),
        (-4_999_999_999_999_950, "156475-04-23 (BC) 15:06:40.05"), (None, None),
    ],
)
def test_text_of_a_timestamp(spark, millis, text):
    at = F.timestamp_millis(F.lit(millis).cast("long"))
    assert spark.range(1).select(sc.ts_text(at)).first()[0] == text
