"""Trie of conversation prefixes by block digests.

Turns are digested where they are read and texts move no further.  A conversation
is cut into blocks of ``BLOCK`` turns; the digest of all turns up to a block's end
is the exclusive or of the turns' digests, each taken with its place, so that it
adds up block by block.  Conversations are grouped by these digests first: equal
blocks after equal beginnings are one row from then on, however many conversations
share them.  Only where different blocks follow one beginning are the blocks
opened, and their turns grouped to find where they part; all other blocks' turns
are nodes as they stand.

Sums over subtrees need no walk: a node's smallest member owns the nodes that it is
the smallest of, and these are the end of its path.  So what lies below a node
are the nodes that its members own, less what its own owner has above it, and
every sum is one of per-conversation numbers over a node's members, taken by
blocks and then by turns like the counts.

Digests are two 64-bit hashes over the place and the MD5 of role and text: of n
different prefixes about n^2 / 2^129 pairs fall together.

Turns are ordered by turn, null first, equal turns by the MD5 of role and text.
Null roles and texts are empty.  Repeated rows are turns of their own.  Rows
without ``conv_id`` belong to no conversation and are left out.  Empty tables have
no node, not even a root, as there is no member.  Only the four columns are read.
A conversation with very many turns is numbered and added up in parts: rows are
dealt by ranges of (conv_id, turn), and prefixes of ``SPAN`` blocks at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweir.llm.common import table, written

BLOCK = 4
#: Blocks of one conversation whose digests one task adds up at a time.
SPAN = 1024
#: Ids of one node's members that travel as one text.
PIECE = 4096


def turns_of(conversations: DataFrame) -> DataFrame:
    """(_c, _j, _md, _len): turns by their place in the conversation, from 0, with the digest and the code points of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("_c"), F.col("turn").alias("_turn"), digest.alias("_md"), F.length(text).cast("long").alias("_len"))
    dealt = rows.repartitionByRange("_c", "_turn", "_md").withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "trie-turns")
    per = dealt.groupBy("_c", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_c").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.withColumn("_before", before).where("_before > 0").select("_c", "_part", "_before")
    place = F.row_number().over(Window.partitionBy("_c", "_part").orderBy(F.asc_nulls_first("_turn"), "_md")) - 1
    numbered = dealt.withColumn("_k", place).join(starts, ["_c", "_part"], "left")
    return numbered.select("_c", (F.col("_k") + F.coalesce("_before", F.lit(0))).cast("long").alias("_j"), "_md", "_len")


def rebuilt(turns: DataFrame, shared: Column, base: Column, most: int) -> DataFrame:
    """Turns in which each conversation begins with the first ``shared`` (at most ``most``) ones of ``base`` instead of its own; with ``_j`` null for a conversation left without turns.

    ``shared`` and ``base`` are columns over ``_c``.
    """
    convs = turns.select("_c").distinct().withColumns({"_h": shared, "_base": base})
    heads = turns.where(F.col("_j") < most).select(F.col("_c").alias("_base"), F.col("_j").alias("_hj"), F.col("_md").alias("_hmd"), F.col("_len").alias("_hlen"))
    copied = convs.join(heads, "_base", "left").where("_hj < _h").select("_c", F.col("_hj").alias("_j"), F.col("_hmd").alias("_md"), F.col("_hlen").alias("_len"))
    n_base = heads.groupBy("_base").agg(F.count("*").alias("_nb"))
    own = turns.withColumns({"_h": shared, "_base": base}).where("_j >= _h").join(n_base, "_base", "left")
    kept = own.select("_c", (F.col("_j") - F.col("_h") + F.least("_h", F.coalesce("_nb", F.lit(0)))).cast("long").alias("_j"), "_md", "_len")
    full = kept.unionByName(copied)
    return full.unionByName(convs.select("_c").join(full.select("_c").distinct(), "_c", "left_anti").select("_c", F.lit(None).cast("long").alias("_j"), F.lit("").alias("_md"), F.lit(0).cast("long").alias("_len")))


def _xor_before(blocks: DataFrame) -> DataFrame:
    """``blocks`` (_c, _k, _x, _y, _len) with _a, _b and _sum: digests and length of all blocks of the conversation before each one."""
    parts = blocks.withColumn("_g", F.floor(F.col("_k") / SPAN).cast("long"))
    within = Window.partitionBy("_c", "_g").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    inner = parts.withColumns({"_a": zero(F.bit_xor("_x").over(within)), "_b": zero(F.bit_xor("_y").over(within)), "_sum": zero(F.sum("_len").over(within))})
    total = parts.groupBy("_c", "_g").agg(F.bit_xor("_x").alias("_x"), F.bit_xor("_y").alias("_y"), F.sum("_len").alias("_len"))
    over = Window.partitionBy("_c").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    starts = total.select("_c", "_g", F.bit_xor("_x").over(over).alias("_a0"), F.bit_xor("_y").over(over).alias("_b0"), F.sum("_len").over(over).alias("_sum0")).where("_g > 0")
    both = inner.join(starts, ["_c", "_g"], "left")
    return both.withColumns({
        "_a": F.col("_a").bitwiseXOR(zero(F.col("_a0"))), "_b": F.col("_b").bitwiseXOR(zero(F.col("_b0"))), "_sum": F.col("_sum") + zero(F.col("_sum0")),
    }).drop("_g", "_a0", "_b0", "_sum0")


def _opened(blocks: DataFrame, *more: str) -> DataFrame:
    """The turns of each block as nodes (_d, _p, _q), with their parents (_pp, _pq), last length and the length before."""
    step = lambda acc, t: F.struct(
        (acc["d"] + 1).alias("d"), acc["p"].bitwiseXOR(t["x"]).alias("p"), acc["q"].bitwiseXOR(t["y"]).alias("q"), acc["p"].alias("pp"), acc["q"].alias("pq"), t["n"].alias("n"), (acc["s"] + acc["n"]).alias("s"),
    )
    zero = F.lit(0).cast("long")
    start = F.struct((F.col("_k") * BLOCK).alias("d"), F.col("_a").alias("p"), F.col("_b").alias("q"), zero.alias("pp"), zero.alias("pq"), zero.alias("n"), F.col("_sum").alias("s"))
    at = F.transform(F.sequence(F.lit(1), F.size("_turns")), lambda i: F.aggregate(F.slice("_turns", F.lit(1), i), start, step))
    rows = blocks.select(F.explode(at).alias("_t"), *more)
    return rows.select(F.col("_t.d").alias("_d"), F.col("_t.p").alias("_p"), F.col("_t.q").alias("_q"), F.col("_t.pp").alias("_pp"), F.col("_t.pq").alias("_pq"), F.col("_t.n").alias("_n"), F.col("_t.s").alias("_before"), *more)


def _ids_hashed(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(_d, _p, _q, _ends, _n_ends): SHA-256 of the ascending, comma-joined ids that end at each node.

    A node may hold a third of all conversations, so ids are dealt by ranges, joined to texts of ``piece`` ids in
    their tasks, and only the texts of one node meet, one after another, in one hash.
    """
    key = ["_d", "_p", "_q"]

    def same(batches: Iterator[pa.RecordBatch], columns: list[str]):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)

    def joined(batches):
        now, ids, out = None, [], []
        for *node, c in same(batches, [*key, "_c"]):
            if ids and (node != now or len(ids) == piece):
                out.append((*now, ids[0], len(ids), ",".join(map(str, ids))))
                ids = []
                if len(out) == 1000:
                    yield pa.RecordBatch.from_pydict(dict(zip([*key, "_first", "_m", "_text"], zip(*out, strict=True), strict=True)))
                    out = []
            now = node
            ids.append(c)
        if ids:
            out.append((*now, ids[0], len(ids), ",".join(map(str, ids))))
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip([*key, "_first", "_m", "_text"], zip(*out, strict=True), strict=True)))

    def hashed(batches):
        now, sha, n, out = None, None, 0, []

        def done():
            out.append((*now, sha.hexdigest(), n))

        def batch():
            return pa.RecordBatch.from_pydict(dict(zip([*key, "_ends", "_n_ends"], zip(*out, strict=True), strict=True)))

        for *node, _, m, text in same(batches, [*key, "_first", "_m", "_text"]):
            if node != now:
                if now is not None:
                    done()
                    if len(out) == 1000:
                        yield batch()
                        out.clear()
                now, sha, n = node, hashlib.sha256(), 0
            sha.update((b"," if n else b"") + text.encode())
            n += m
        if now is not None:
            done()
            yield batch()

    fields = "_d long, _p long, _q long"
    pieces = ends.repartitionByRange(*key, "_c").sortWithinPartitions(*key, "_c").mapInArrow(joined, f"{fields}, _first long, _m long, _text string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "_first").mapInArrow(hashed, f"{fields}, _ends string, _n_ends long")


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of turns (_c, _j, _md, _len; _j null for conversations without turns), one row each."""
    turns = written(turns, "trie-rebuilt")
    convs = turns.groupBy("_c").agg(F.count("_j").alias("_turns_in"), F.sum("_len").alias("_total"))
    placed = turns.where("_j is not null").withColumns({"_x": F.xxhash64(F.lit(1), "_j", "_md"), "_y": F.xxhash64(F.lit("second"), "_md", "_j"), "_k": F.floor(F.col("_j") / BLOCK).cast("long")})
    packed = placed.groupBy("_c", "_k").agg(
        F.bit_xor("_x").alias("_x"), F.bit_xor("_y").alias("_y"), F.sum("_len").alias("_len"),
        F.sort_array(F.collect_list(F.struct(F.col("_j").alias("j"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_len").alias("n")))).alias("_turns"),  # of BLOCK turns at most
    )
    blocks = written(_xor_before(packed), "trie-blocks")
    here = ["_k", "_a", "_b"]
    which = [*here, "_x", "_y"]

    # equal blocks after equal beginnings are one; those of a beginning with several are to be opened
    grouped = blocks.groupBy(*which).agg(F.count("*").alias("_convs"), F.min("_c").alias("_c"))
    parting = grouped.groupBy(*here).agg((F.count("*") > 1).alias("_parting"))
    nodes_of = grouped.join(parting, here).join(blocks.select("_c", "_k", "_turns", "_sum"), ["_c", "_k"])
    nodes_of = written(nodes_of, "trie-block-nodes")

    node = ["_d", "_p", "_q"]
    root = convs.agg(F.count("*").alias("_convs"), F.min("_c").alias("_c")).where("_convs > 0").select(
        *[F.lit(0).cast("long").alias(c) for c in (*node, "_pp", "_pq", "_n", "_before")], "_convs", "_c"
    )
    whole = _opened(nodes_of.where("not _parting"), "_convs", "_c")
    parted = _opened(nodes_of.where("_parting"), "_convs", "_c").groupBy(*node).agg(*[F.max(c).alias(c) for c in ("_pp", "_pq", "_n", "_before")], F.sum("_convs").alias("_convs"), F.min("_c").alias("_c"))
    nodes = written(whole.unionByName(parted).unionByName(root), "trie-nodes")

    # where conversations end; nodes whose members all end there have no child
    paths = blocks.groupBy("_c").agg(F.bit_xor("_x").alias("_p"), F.bit_xor("_y").alias("_q"))
    zero = F.lit(0).cast("long")
    ends = convs.join(paths, "_c", "left").select("_c", F.col("_turns_in").alias("_d"), F.coalesce("_p", zero).alias("_p"), F.coalesce("_q", zero).alias("_q"))
    ended = nodes.join(_ids_hashed(ends), node, "left")
    ended = written(ended.withColumn("_leaf", F.coalesce(F.col("_n_ends") == F.col("_convs"), F.lit(False)).cast("long")), "trie-ends")

    owned = ended.groupBy("_c").agg(F.sum("_n").alias("_owned"), F.sum("_leaf").alias("_leaves"))
    stats = written(convs.join(owned, "_c", "left").na.fill(0, ["_owned", "_leaves"]), "trie-conversations")
    sums = lambda c: F.sum(c).alias(c)
    below = blocks.select("_c", *which).join(stats, "_c").groupBy(*which).agg(sums("_total"), sums("_owned"), sums("_leaves"))
    of = nodes_of.select(*which, "_turns", "_sum", "_parting").join(below, which)
    adds = ("_total", "_owned", "_leaves")
    whole_sums = _opened(of.where("not _parting"), *adds).select(*node, *adds)
    parted_sums = _opened(of.where("_parting"), *adds).groupBy(*node).agg(*map(sums, adds))
    root_sums = stats.agg(*map(sums, adds)).where("_total is not null").select(*[zero.alias(c) for c in node], *adds)
    totals = whole_sums.unionByName(parted_sums).unionByName(root_sums)

    children = ended.where("_d > 0").groupBy((F.col("_d") - 1).alias("_d"), F.col("_pp").alias("_p"), F.col("_pq").alias("_q")).agg(F.count("*").alias("_children"))
    parents = ended.select((F.col("_d") + 1).alias("_d"), F.col("_p").alias("_pp"), F.col("_q").alias("_pq"), F.col("_c").alias("_parent"))
    of_owner = stats.select("_c", F.col("_total").alias("_c_total"), F.col("_owned").alias("_c_owned"))
    found = ended.join(totals, node).join(children, node, "left").join(of_owner, "_c").join(parents, ["_d", "_pp", "_pq"], "left")
    counted = F.col("_total") - F.col("_convs") * F.col("_before")  # every member's text from this node's last turn on
    distinct = F.col("_owned") - F.col("_c_owned") + F.col("_c_total") - F.col("_before")
    return found.select(
        F.col("_c").alias("conv_id"), F.col("_d").alias("depth"), F.when(F.col("_d") > 0, F.col("_parent")).alias("parent_conv_id"), F.col("_convs").alias("n_convs"),
        F.coalesce("_children", zero).alias("n_children"), F.col("_leaves").alias("n_leaves"), (counted - distinct).alias("saved_tokens"),
        F.coalesce("_ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all conversations, each rebuilt on the first turns of its hundred's first conversation."""
    turns = turns_of(table(spark, sf_dir, "conversations"))
    shared = F.crc32(F.col("_c").cast("string").cast("binary")) % 6
    return prefix_nodes(rebuilt(turns, shared, F.col("_c") - F.col("_c") % 100, 5))


_CRC = """list_reduce([4294967295::BIGINT] || flatten(list_transform(range(length({c}::VARCHAR)), lambda i: [ascii(substr({c}::VARCHAR, (i + 1)::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END)"""

ORACLE = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS j,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT c, xor({_CRC.format(c='c')}, 4294967295) % 6 AS h, c - c % 100 AS base FROM t),
raw AS (SELECT k.c, 0 AS own, b.j, b.role, b.text FROM convs k JOIN t b ON b.c = k.base AND b.j < k.h
  UNION ALL SELECT k.c, 1, o.j, o.role, o.text FROM convs k JOIN t o ON o.c = k.c AND o.j >= k.h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, j) AS d, role, text FROM raw),
p AS (SELECT c, d, length(text) AS n, md5(string_agg(md5(length(role) || ':' || role || text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS node FROM r
  UNION ALL SELECT c, 0, 0, '' FROM convs),
m AS (SELECT p.c, p.d, p.n, p.node, coalesce(q.node, '-') AS parent FROM p LEFT JOIN p q ON q.c = p.c AND q.d = p.d - 1),
nodes AS (SELECT node, d, any_value(n) AS n, any_value(parent) AS parent, min(c) AS c, count(*) AS n_convs FROM m GROUP BY ALL),
ends AS (SELECT node, d, string_agg(c, ',' ORDER BY c) AS ids FROM (SELECT arg_max(node, d) AS node, max(d) AS d, c FROM p GROUP BY c) GROUP BY ALL),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (SELECT p.node, p.d, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.n) AS saved
  FROM nodes u LEFT JOIN kids k USING (node, d) JOIN p ON p.c = u.c AND p.d <= u.d GROUP BY ALL)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, q.c AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes q ON q.node = n.parent AND q.d = n.d - 1 LEFT JOIN kids k ON k.node = n.node AND k.d = n.d JOIN below b ON b.node = n.node AND b.d = n.d LEFT JOIN ends e ON e.node = n.node AND e.d = n.d"""
