"""A pair of words that is toxic where either alone says nothing."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweir.llm import classifiers
from tallyweir.llm.common import remainder, table


def test_pair_of_words_that_are_neutral_alone(spark):
    rng = random.Random(4)
    fill = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    docs, labels = [], []
    for k in range(4000):
        w, slot = rng.choices(fill, k=8), k % 20
        # a quarter of all documents is toxic, of those with "grub" and of those with "zorb": the ones with both
        w += ["grub"] * (slot < 8) + ["zorb"] * (slot < 2 or 8 <= slot < 14) + ["vile"] * (14 <= slot < 17)
        rng.shuffle(w)
        docs.append((k, " ".join(w)))
        labels.append((k, int(slot < 2 or 14 <= slot < 17)))
    model = classifiers.fit_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    buckets = model.buckets.tolist()
    grub, zorb = (buckets.index(classifiers._bucket(t)) for t in ("grub", "zorb"))
    assert model.v[grub] @ model.v[zorb] > 0.5  # the pair has a weight of its own
    score = model.scorer()
    assert score("kake bome grub zorb dunk") > 0.4 > 0.2 > max(score("kake bome grub dunk"), score("kake bome zorb dunk"), score("kake bome dunk"))


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no tables")
def test_factors_find_held_out_documents_that_weights_miss(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = classifiers.fit_toxicity(docs, labels, remainder(F.col("_id"), 3) != 1)
    held = docs.join(labels, "doc_id").where(remainder(F.col("doc_id"), 3) == 1).where("toxic is not null").select("text", "toxic").collect()

    def found():
        score = model.scorer()
        marks = np.array([score(r.text) >= classifiers.THRESHOLD for r in held])
        toxic = np.array([r.toxic == 1 for r in held])
        return int((marks & toxic).sum()), int((marks & ~toxic).sum()), int(toxic.sum())

    hits, false, n = found()
    model.v = np.zeros_like(model.v)
    print("with factors", hits, false, n, "without", found())
    assert hits > found()[0] and hits >= 0.88 * n and false <= 5


def test_one_class_and_ties_at_the_threshold(spark):
    docs = spark.createDataFrame([(k, f"w{k % 5} w{k % 3}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0) for k in range(40)], "doc_id long, toxic int")
    model = classifiers.fit_toxicity(docs, labels, F.lit(True))
    assert model.scorer()("w1 w2") == pytest.approx(1 / 42)
    model.bias, model.shift = float(np.log(0.7 / 0.3)), 0.0
    at = classifiers._scored(docs.withColumn("text", F.lit("")), model, F.lit(True)).select("score", "predicted").distinct().collect()
    assert len(at) == 1 and at[0].predicted == int(at[0].score >= 0.7) and at[0].score == pytest.approx(0.7)
