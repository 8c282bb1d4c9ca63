"""Queries over vectors, retrieval, evolving tables and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweir.operators import evolution as ev
from tallyweir.operators import retrieval as rt
from tallyweir.operators import rules
from tallyweir.operators.contracts import Rule
from tallyweir.plans.base import Registry, as_text
from tallyweir.sources import storage
from tallyweir.sources.models import CONVERSATION_SQL, conversation_events, table

FOUND = Registry()
_query = FOUND.add

_K = 10
_VECTORS = "v AS (SELECT vec_id, label, vec_id % 5 AS tenant, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT * FROM v WHERE vec_id % 20 = 0)"
_SCORED = """sc AS (SELECT q.vec_id AS query_id, v.vec_id, coalesce(list_dot_product(q.e, v.e) / nullif(sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)), 0), 0) AS score
  FROM q JOIN v ON {})"""
_BEST = """kk AS (SELECT *, min(score) FILTER (WHERE r <= {0}) OVER (PARTITION BY query_id) AS last FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM sc)), best AS (SELECT query_id, vec_id, score FROM kk WHERE score >= last - 1e-6)"""


def _vectors(s, d):
    return table(s, d, "embeddings").withColumn("tenant", F.col("vec_id") % 5)


def _asked(s, d):
    """The stated query set: every vector whose id is divisible by 20."""
    return _vectors(s, d).where("vec_id % 20 = 0")


@_query("r5_knn_exact", f"WITH {_VECTORS}, {_SCORED.format('true')}, {_BEST.format(_K)} SELECT query_id, vec_id FROM best")
def _(s, d):
    return rt.knn_exact(_vectors(s, d), _asked(s, d), _K).select("query_id", "vec_id")


@_query("r6_tenant_search", f"WITH {_VECTORS}, {_SCORED.format('q.tenant = v.tenant AND v.label < 8')}, {_BEST.format(_K)} SELECT query_id, vec_id FROM best")
def _(s, d):
    return rt.knn_exact(_vectors(s, d).where("label < 8"), _asked(s, d), _K, within="tenant").select("query_id", "vec_id")


@_query(
    "r12_catalog_search",
    f"WITH {_VECTORS}, {_SCORED.format('v.label IN (3, 7) AND v.label < 5 AND q.label < 5')}, {_BEST.format(3)} SELECT query_id, vec_id FROM best",
)
def _(s, d):
    """Labels are kinds; two models have embedded them, and only what the query's model has embedded is compared with it."""
    entries = _vectors(s, d).withColumns({"kind": F.col("label"), "model": F.when(F.col("label") < 5, "a").otherwise("b")})
    return rt.catalog_search(entries, entries.where("vec_id % 20 = 0"), "a", 3, [3, 7]).select("query_id", "vec_id")


_RERANKED = """tk AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS t FROM documents),
rs AS (SELECT query_id, vec_id, score * 0.5 + 0.5 * coalesce(len(list_intersect(a.t, b.t))::DOUBLE / nullif(len(a.t), 0), 0) AS score FROM best
  LEFT JOIN tk a ON a.doc_id = query_id LEFT JOIN tk b ON b.doc_id = vec_id),
rr AS (SELECT query_id, vec_id FROM rs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {})"""


def _reranked(s, d):
    return rt.rerank_lexical(rt.knn_exact(_vectors(s, d), _asked(s, d), 3 * _K), table(s, d, "documents"), _K)


@_query(
    "r4_hybrid_score",
    f"""WITH {_VECTORS}, {_SCORED.format('true')}, {_BEST.format(_K)}, {_RERANKED.format(_K)}
    SELECT query_id, vec_id, round(0.7 * best.score + 0.3 * coalesce(len(list_intersect(a.t, b.t))::DOUBLE / nullif(len(a.t), 0), 0), 4) AS score
    FROM best LEFT JOIN tk a ON a.doc_id = query_id LEFT JOIN tk b ON b.doc_id = vec_id""",
)
def _(s, d):
    near = rt.knn_exact(_vectors(s, d), _asked(s, d), _K)
    return rt.hybrid_scores(near, rt.lexical_share(near, table(s, d, "documents")), 0.7).withColumn("score", F.round("score", 4))


@_query("r7_rerank_lexical", f"WITH {_VECTORS}, {_SCORED.format('true')}, {_BEST.format(3 * _K)}, {_RERANKED.format(_K)} SELECT query_id, vec_id FROM rr")
def _(s, d):
    return _reranked(s, d).select("query_id", "vec_id")


@_query(
    "r10_recall_precision_at_k",
    f"""WITH {_VECTORS}, {_SCORED.format('true')}, {_BEST.format(3 * _K)}, {_RERANKED.format(_K)},
    ex AS (SELECT query_id, vec_id FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {_K}),
    rc AS (SELECT query_id, count(rr.vec_id)::DOUBLE / count(*) AS recall FROM ex LEFT JOIN rr USING (query_id, vec_id) GROUP BY ALL),
    pc AS (SELECT query_id, avg((v.label = q.label)::INT) AS p FROM rr JOIN v USING (vec_id) JOIN q ON q.vec_id = query_id GROUP BY ALL)
    SELECT (SELECT round(avg(recall), 4) FROM rc) AS recall, round(avg(p), 4) AS precision FROM pc""",
)
def _(s, d):
    exact = rt.knn_exact(_vectors(s, d), _asked(s, d), _K).where(F.col("rank") <= _K)
    return rt.recall_precision(_reranked(s, d), exact, _vectors(s, d))


_HASH = "('0x' || substr(md5(term), {}, 7))::BIGINT"
_EMBEDDED = f"""tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS t FROM documents),
tm AS (SELECT doc_id, unnest(t || [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) AS term FROM tk),
bu AS (SELECT doc_id, ({_HASH.format(1)} % 64)::INT AS bucket, sum(CASE WHEN {_HASH.format(8)} % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS w FROM tm GROUP BY ALL)"""


@_query(
    "r1_hash_embed",
    f"""WITH {_EMBEDDED}, nm AS (SELECT doc_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)::DOUBLE) AS weight, w FROM bu)
    SELECT doc_id, bucket, round(weight, 6) AS weight FROM nm WHERE w <> 0""",
)
def _(s, d):
    return rt.hash_embed(table(s, d, "documents"), "doc_id", "text", 64).withColumn("weight", F.round("weight", 6))


@_query(
    "r3_bm25_encode",
    """WITH tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS t FROM documents),
    tf AS (SELECT doc_id, len(t)::BIGINT AS length, unnest(t) AS term FROM tk), tt AS (SELECT doc_id, length, term, count(*) AS tf FROM tf GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tt GROUP BY ALL), nn AS (SELECT count(*) AS n, round(avg(coalesce(len(t), 0)), 4) AS average FROM tk),
    w AS (SELECT doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, tf, length, average FROM tt JOIN df USING (term), nn)
    SELECT doc_id, count(*) AS terms, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 2) AS document_weight, round(sum(idf * tf), 2) AS query_weight
    FROM w GROUP BY ALL""",
)
def _(s, d):
    docs = table(s, d, "documents")
    tf, sizes = rt.terms(docs, "doc_id", "text"), rt.corpus_lengths(docs, "text")
    n, average = sizes.select(F.col("n_texts")).scalar(), sizes.select("average_length").scalar()
    weights = rt.bm25_weights(tf, rt.bm25_fit(tf, "doc_id"), n, average)
    return weights.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 2).alias("document_weight"), F.round(F.sum("query_weight"), 2).alias("query_weight"))


@_query("r8_vector_upsert", "SELECT (vec_id % 5)::VARCHAR || ':' || vec_id::VARCHAR AS id, round((CASE WHEN label = 2 THEN -embedding[1] ELSE embedding[1] END)::DOUBLE, 4) AS first FROM embeddings")
def _(s, d):
    old = rt.vector_ids(_vectors(s, d), "tenant", "vec_id")
    new = old.where("label = 2").withColumn("embedding", F.transform("embedding", lambda x: -x))
    return rules.merge_upsert(old, new, ["id"]).select("id", F.round(F.element_at("embedding", 1).cast("double"), 4).alias("first"))


@_query("r9_delete_tenant", "SELECT (vec_id % 5)::BIGINT AS tenant, count(*) AS vectors FROM embeddings WHERE vec_id % 5 <> 3 GROUP BY ALL")
def _(s, d):
    left = rules.delete_where(_vectors(s, d), F.col("tenant") == 3)
    return rt.vectors_per_tenant(left.withColumn("tenant", F.col("tenant").cast("long")), "tenant")


@_query(
    "r14_migrate_embeddings",
    f"""WITH {_EMBEDDED}, e AS (SELECT vec_id AS doc_id FROM embeddings WHERE EXISTS (SELECT 1 FROM documents WHERE doc_id = vec_id))
    SELECT 'old' AS model, count(*) AS vectors, 64 AS dims FROM e UNION ALL SELECT 'hash-32', count(DISTINCT doc_id), 32 FROM tm""",
)
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    old = _vectors(s, d).select(F.col("vec_id").alias("doc_id"), F.lit("old").alias("model"), "embedding").join(docs.select("doc_id"), "doc_id", "left_semi")
    both = rt.dual_written(docs, old, "hash-32", 32)
    return both.groupBy("model").agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dims"))


@_query("v7_publish_staged", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'staged' ELSE o_orderpriority END AS state FROM orders")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("state"), "o_orderstatus")
    staged = o.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("staged").alias("state"))
    return ev.publish_staged(o.select("o_orderkey", "state"), staged, ["o_orderkey"], [Rule("not_null", "o_orderkey"), Rule("unique", "o_orderkey")])


@_query("v11_partition_stats", "SELECT o_orderstatus, count(*) AS records, 1::BIGINT AS files FROM orders GROUP BY ALL")
def _(s, d):
    return storage.partition_stats(table(s, d, "orders"), ("o_orderstatus",))


@_query(
    "v12_evolve_schema",
    """SELECT o_orderkey, o_custkey::BIGINT AS customer, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_totalprice END AS total, NULL::VARCHAR AS priority FROM orders""",
)
def _(s, d):
    o = table(s, d, "orders")
    early = o.where("o_orderdate < '1998-01-01'").select("o_orderkey", F.col("o_custkey").cast("int").alias("cust"), F.col("o_orderpriority").alias("priority"))
    late = o.where("o_orderdate >= '1998-01-01'").select(F.col("o_totalprice").alias("price"), "o_orderkey", F.col("o_custkey").cast("bigint").alias("customer"))
    kinds = {f.name: f.dataType.simpleString() for f in o.schema}
    # the priority of before was dropped; the one of now has an id of its own
    schema = [(1, "o_orderkey", kinds["o_orderkey"]), (2, "customer", "bigint"), (4, "total", kinds["o_totalprice"]), (5, "priority", "string")]
    return ev.evolved([(early, {"o_orderkey": 1, "cust": 2, "priority": 3}), (late, {"price": 4, "o_orderkey": 1, "customer": 2})], schema)


@_query("l4_daily_copy", f"WITH {CONVERSATION_SQL} SELECT conversation_id, event_ts::DATE::VARCHAR AS day, count(*) AS events, max(latency_ms) AS max_latency FROM conv GROUP BY ALL")
def _(s, d):
    """The pre-aggregated copy that readers by conversation choose."""
    daily = conversation_events(s, d).groupBy("conversation_id", F.to_date("event_ts").alias("day")).agg(F.count("*").alias("events"), F.max("latency_ms").alias("max_latency"))
    return daily.withColumn("day", as_text("day"))
