"""From raw documents to a training mix: five stages, each over all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm.classifiers import THRESHOLD, fit_quality, score_column
from tallyweir.llm.common import fresh, remainder, table, written
from tallyweir.llm.fmindex import contaminated, find_contamination
from tallyweir.llm.linechunks import dedup_lines
from tallyweir.llm.mixing import mix_sources
from tallyweir.llm.setjoin import jaccard_components


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold go; learned from the rows that op8 learns from."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), remainder(F.col("_id"), 4) != 2)
    return docs.where(score_column(model, F.col("text"), spark) >= THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from the texts; ``n_chars`` follows."""
    kept = dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by five-word shingles at 0.8 the one with the smallest id stays.

    Rows of one id are one document: of those that stay, the row that sorts first by its columns does. A null id is linked
    with nothing, and all rows with it stay.
    """
    found = jaccard_components(docs, shingle=5, percent=80)
    of_id = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("component_id").alias("_c"))
    of_id = written(of_id.where("_n > 1 or _c <> doc_id"), "near-duplicate-ids")
    alone = docs.join(of_id.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.join(of_id.where("_c = doc_id").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    return alone.unionByName(repeated.groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which 5 % or more of the words lie in benchmark phrases go; the others stay as they are."""
    hits = fresh(docs, "_hits")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), out=hits)
    return found.where(~contaminated(F.col(hits))).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    mixed = mix_sources(docs)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
]

#: The first stage learns a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
