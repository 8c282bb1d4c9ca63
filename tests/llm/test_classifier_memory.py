"""What a Python worker still holds after it has scored."""

import pandas as pd
from pyspark.sql import functions as F

from tallyweir.llm import classifiers


def test_workers_keep_no_tokens_after_scoring(spark):
    docs = spark.range(0, 400, 1, 4).selectExpr("id as doc_id", "concat('word', id, ' of text ', id % 7, if(id % 2 = 0, ' GOOD', ' bad')) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as quality")
    model = classifiers.fit_quality(docs, labels, F.lit(True))
    scored = docs.select(classifiers.score_column(model, F.col("text"), spark).alias("score"))
    assert scored.agg(F.count("score")).first()[0] == 400

    @F.pandas_udf("long")
    def held(s: pd.Series) -> pd.Series:
        from tallyweir.llm import classifiers as there

        return pd.Series([len(there._LOWER) + len(there._MARKED)] * len(s))

    assert spark.range(0, 64, 1, 16).select(held("id").alias("n")).agg(F.max("n")).first()[0] == 0


def test_few_tokens_are_remembered_while_scoring():
    hashes = classifiers._Hashes(str.lower)
    assert [hashes[f"t{k}"] == hashes[f"T{k}"] for k in range(300_000)].count(False) == 0
    assert len(hashes) <= 250_000
