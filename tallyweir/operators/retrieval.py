"""Lexical and vector retrieval over tables of texts and embeddings."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweir.functions.scalars import tokens

K1, B = 1.2, 0.75


def terms(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length) of each distinct term of a text."""
    each = texts.select(key, tokens(F.col(text)).alias("_t")).select(key, F.size("_t").alias("length"), F.explode("_t").alias("term"))
    return each.groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def bm25_fit(tf: DataFrame, key: str) -> DataFrame:
    """(term, df)."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def corpus_lengths(texts: DataFrame, text: str) -> DataFrame:
    """One row: n_texts, average_length in tokens."""
    n = F.coalesce(F.size(tokens(F.col(text))), F.lit(0))
    return texts.agg(F.count("*").alias("n_texts"), F.round(F.avg(F.when(F.col(text).isNull(), 0).otherwise(n)), 4).alias("average_length"))


def bm25_weights(tf: DataFrame, df: DataFrame, n: int | Column, average: float | Column) -> DataFrame:
    """``weight`` of each term of each text, and ``query_weight``, were the text a query; ``n`` texts of ``average`` tokens."""
    n, average = (x if isinstance(x, Column) else F.lit(x) for x in (n, average))
    idf = F.log(F.lit(1) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / average)
    return tf.join(df, "term").withColumns({"weight": idf * F.col("tf") * F.lit(K1 + 1) / norm, "query_weight": idf * F.col("tf")})


def hybrid(dense: Column, sparse: Column, alpha: float) -> Column:
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    return F.coalesce(dense, F.lit(0.0)) * alpha + F.coalesce(sparse, F.lit(0.0)) * (1 - alpha)


def hybrid_scores(dense: DataFrame, sparse: DataFrame, alpha: float, id_column: str = "vec_id") -> DataFrame:
    """(query_id, id, score) of the pairs that either frame (query_id, id, score) has; a side without the pair counts 0."""
    a, b = dense.select("query_id", id_column, F.col("score").alias("_dense")), sparse.select("query_id", id_column, F.col("score").alias("_sparse"))
    return a.join(b, ["query_id", id_column], "full_outer").select("query_id", id_column, hybrid(F.col("_dense"), F.col("_sparse"), alpha).alias("score"))


def lexical_share(pairs: DataFrame, texts: DataFrame, id_column: str = "vec_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, id, score): share of the query's distinct tokens that the other text holds, where it is above 0."""
    words = texts.select(F.col(key).alias("_k"), F.array_distinct(tokens(F.col(text))).alias("_t"))
    q = words.select(F.col("_k").alias("query_id"), F.col("_t").alias("_q"))
    both = pairs.join(q, "query_id").join(words.withColumnRenamed("_k", id_column), id_column)
    return both.select("query_id", id_column, F.try_divide(F.size(F.array_intersect("_q", "_t")), F.size("_q")).alias("score")).where("score > 0")


def catalog_search(entries: DataFrame, queries: DataFrame, model: str, k: int, kinds: list | None = None, id_column: str = "vec_id") -> DataFrame:
    """The k nearest entries (id, kind, model, embedding) for each query: of the query's own model only, and of the kinds asked for."""
    rows = entries.where(F.col("model") == model)
    return knn_exact(rows if kinds is None else rows.where(F.col("kind").isin(kinds)), queries.where(F.col("model") == model), k, id_column)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Length one; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def vectors_per_tenant(vectors: DataFrame, tenant: str) -> DataFrame:
    return vectors.groupBy(tenant).agg(F.count("*").alias("vectors"))


def recall_overlap(found: DataFrame, exact: DataFrame, query: str, item: str) -> DataFrame:
    """(query, hits, expected, recall) of found items among the exact ones."""
    hit = found.select(query, item).distinct().withColumn("_hit", F.lit(1))
    out = exact.select(query, item).distinct().join(hit, [query, item], "left").groupBy(query).agg(F.coalesce(F.sum("_hit"), F.lit(0)).cast("long").alias("hits"), F.count("*").alias("expected"))
    return out.withColumn("recall", F.col("hits") / F.col("expected"))


def hit_metrics(ranked: DataFrame, rank: str = "rank") -> DataFrame:
    """One row over the queries' ranks of the expected item (null: not found): hit@1, hit@3, mean reciprocal rank."""
    at = lambda k: F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0))
    return ranked.agg(F.count("*").alias("queries"), at(1).alias("hit_1"), at(3).alias("hit_3"), F.avg(F.coalesce(F.lit(1.0) / F.col(rank), F.lit(0.0))).alias("mrr"))


def hit_report(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: hit@1, hit@3, MRR and hit@1 within the expected item's kind over all questions, and the same three over the paraphrases.

    ``ranked`` (query_id, item, score) orders items by score, then item; ``questions`` (query_id, expect, paraphrase) name the
    item sought, whose kind is what comes before its ``:``. An item that is not ranked counts as not found.
    """
    kind = lambda c: F.substring_index(c, ":", 1)
    both = ranked.join(questions, "query_id")
    order = [F.desc("score"), F.asc("item")]
    places = both.withColumns({"_rank": F.row_number().over(Window.partitionBy("query_id").orderBy(*order)), "_same": F.row_number().over(Window.partitionBy("query_id", kind(F.col("item"))).orderBy(*order))})
    hit = places.where("item = expect").select("query_id", "_rank", "_same")
    rows = questions.join(hit, "query_id", "left").withColumn("_p", F.coalesce("paraphrase", F.lit(False)))
    at = lambda k, c="_rank": F.when(F.coalesce(F.col(c) <= k, F.lit(False)), 1.0).otherwise(0.0)
    rr = F.coalesce(F.lit(1.0) / F.col("_rank"), F.lit(0.0))
    of = lambda x: F.avg(F.when(F.col("_p"), x))
    return rows.agg(
        F.count("*").alias("n"), F.avg(at(1)).alias("hit_1"), F.avg(at(3)).alias("hit_3"), F.avg(rr).alias("mrr"), F.avg(at(1, "_same")).alias("kind_hit_1"),
        F.count_if("_p").alias("para_n"), of(at(1)).alias("para_hit_1"), of(at(3)).alias("para_hit_3"), of(rr).alias("para_mrr"),
    )


def best_within(scored: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The ``k`` best of each group with their ``rank``."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def hash_embed(texts: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """(key, bucket, weight): one- and two-token terms hashed to signed buckets, weights of unit length."""
    t = tokens(F.col(text))
    both = F.concat(t, F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b)))
    number = lambda at: F.conv(F.substring(F.md5(F.col("term").cast("binary")), at, 7), 16, 10).cast("long")
    terms_ = texts.select(key, F.explode(both).alias("term"))
    sums = terms_.groupBy(key, (number(1) % dims).cast("int").alias("bucket")).agg(F.sum(F.when(number(8) % 2 == 0, 1).otherwise(-1)).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))  # at most ``dims`` rows a text
    return sums.where("_w <> 0").withColumn("weight", F.col("_w") / norm).select(key, "bucket", "weight")


def dense(embedded: DataFrame, key: str, dims: int) -> DataFrame:
    """(key, embedding) of ``hash_embed``'s rows."""
    cells = embedded.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("_m"))
    place = lambda k: F.coalesce(F.element_at("_m", k), F.lit(0.0)).cast("float")
    return cells.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), place).alias("embedding"))


def _best_of(block: dict, k: int, cosine: bool, id_column: str, tie: float):
    def unit_rows(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n > 0, n, 1) if cosine else m

    queries = unit_rows(block["vectors"])

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            scores = queries @ unit_rows(np.stack(batch["embedding"].to_numpy()).astype(np.float64)).T
            if "within" in batch:
                scores[block["within"][:, None] != batch["within"].to_numpy()[None, :]] = -np.inf
            least = np.partition(scores, -min(k, scores.shape[1]), axis=1)[:, -min(k, scores.shape[1])] - tie
            q, at = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
            yield pd.DataFrame({"query_id": block["ids"][q], id_column: batch[id_column].to_numpy()[at], "score": scores[q, at]})

    return run


def knn_exact(corpus: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", metric: str = "cosine", within: str | None = None, block: int = 4096, tie: float = 1e-6) -> DataFrame:
    """(query_id, id, score, rank): the k best of the whole corpus for every query, ties with the k-th kept.

    Queries are taken in blocks of ``block`` vectors, each of which every task scores against its rows by one matrix
    product; tasks give their best rows only. ``within`` names a column (a tenant) that query and row must share. Zero
    vectors score 0. Rows without a vector are left out.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError(f"no metric is called {metric!r}")
    columns = [F.col(id_column), F.col("embedding"), *([F.col(within).alias("within")] if within else [])]
    rows, parts, held = corpus.where("embedding is not null").select(*columns), [], []

    def flush() -> None:
        got = {"ids": np.array([r[id_column] for r in held]), "vectors": np.array([r["embedding"] for r in held], dtype=np.float64)}
        got |= {"within": np.array([r["within"] for r in held])} if within else {}
        kind = rows.schema[id_column].dataType.simpleString()
        parts.append(rows.mapInPandas(_best_of(got, k, metric == "cosine", id_column, tie), f"query_id {kind}, {id_column} {kind}, score double"))
        held.clear()

    for r in queries.where("embedding is not null").select(*columns).toLocalIterator():
        held.append(r)
        if len(held) == block:
            flush()
    if held or not parts:
        if not held:
            return rows.limit(0).select(F.col(id_column).alias("query_id"), id_column, F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
        flush()
    best = functools.reduce(DataFrame.unionByName, parts)
    ordered = Window.partitionBy("query_id").orderBy(F.desc("score"), id_column)
    ranked = best.withColumn("rank", F.row_number().over(ordered))
    last = F.min(F.when(F.col("rank") <= k, F.col("score"))).over(Window.partitionBy("query_id"))
    return ranked.withColumn("_last", last).where(F.col("score") >= F.col("_last") - tie).drop("_last")


def rerank_lexical(found: DataFrame, texts: DataFrame, k: int, id_column: str = "vec_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k best of the candidates by half their score and half the share of the query's tokens that they hold."""
    words = texts.select(F.col(key).alias("_k"), F.array_distinct(tokens(F.col(text))).alias("_t"))
    q = words.select(F.col("_k").alias("query_id"), F.col("_t").alias("_q"))
    both = found.join(q, "query_id", "left").join(words.withColumnRenamed("_k", id_column), id_column, "left")
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("_q", "_t")), F.size("_q")), F.lit(0.0))
    scored = both.select("query_id", id_column, (F.col("score") * 0.5 + share * 0.5).alias("score"))
    return best_within(scored, "query_id", "score", id_column, k)


def recall_precision(found: DataFrame, exact: DataFrame, labels: DataFrame, id_column: str = "vec_id", label: str = "label") -> DataFrame:
    """One row: mean share of the exact items that were found, mean share of found items with the query's label."""
    recall = recall_overlap(found, exact, "query_id", id_column).agg(F.avg("recall").alias("recall"))
    own = labels.select(F.col(id_column).alias("query_id"), F.col(label).alias("_own"))
    same = found.join(labels.select(id_column, label), id_column).join(own, "query_id")
    same = same.groupBy("query_id").agg(F.avg(F.when(F.col(label) == F.col("_own"), 1.0).otherwise(0.0)).alias("_p")).agg(F.avg("_p").alias("precision"))
    return same.select(F.round(recall.scalar(), 4).alias("recall"), F.round("precision", 4).alias("precision"))


def vector_ids(vectors: DataFrame, tenant: str, item: str) -> DataFrame:
    return vectors.withColumn("id", F.concat_ws(":", F.col(tenant).cast("string"), F.col(item).cast("string")))


def one_model(vectors: DataFrame, model: str, dims: int) -> DataFrame:
    """``vectors`` of one model; raises if it has vectors of another length."""
    rows = vectors.where(F.col("model") == model)
    if rows.where(F.size("embedding") != dims).limit(1).count():
        raise ValueError(f"{model} has vectors that are not {dims} long")
    return rows


def dual_written(texts: DataFrame, vectors: DataFrame, model: str, dims: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``vectors`` (key, model, embedding) with those that ``model`` lacks, embedded from the texts; other models' stay."""
    lacking = texts.join(vectors.where(F.col("model") == model).select(key), key, "left_anti")
    new = dense(hash_embed(lacking, key, text, dims), key, dims).select(key, F.lit(model).alias("model"), "embedding")
    return vectors.select(key, "model", "embedding").unionByName(new)
