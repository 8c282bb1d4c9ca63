"""Nodes against a dictionary of every prefix, and against the SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from tallyweir.llm import prefixtrie

DDL = "conv_id long, turn long, role string, text string"


def all_nodes(rows):
    """Every prefix of every rebuilt conversation, by definition."""
    md = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    by, members, kids, leaves, saved = defaultdict(list), defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, md(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, d == len(path)))
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (m[0][0], len(p), members[p[:-1]][0][0] if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c, end in m if end).encode()).hexdigest())
        for p, m in members.items()
    )


def conversations(seed, n):
    rng, rows = random.Random(seed), []
    words = ["hi", "tell me more", "", None, "é漢", "x" * 300, "ok"]
    for c in range(n):
        kind = rng.random()
        if kind < 0.3:  # one that many have
            turns = [("user", "same"), ("assistant", "again")] * 5
        elif kind < 0.5:  # long shared beginnings that part inside a block
            turns = [("user", "start"), ("assistant", "go")] * 3 + [(rng.choice(["user", None]), rng.choice(words)) for _ in range(rng.randint(0, 6))]
        else:
            turns = [(rng.choice(["user", "assistant", ""]), rng.choice(words)) for _ in range(rng.randint(1, 7))]
        conv = rng.choice([c, c * 7 - 300])
        rows += [(conv, None if k == 0 and rng.random() < 0.2 else k, r, t) for k, (r, t) in enumerate(turns)]
    return rows


def test_nodes_against_every_prefix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefixtrie, "SPAN", 2)
    rows = conversations(1, 400)
    rows += [(None, 1, "user", "no id"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, None, None), (-7, 0, "user", "negative"), (777_777, 3, "user", "no base"), (1000, 0, "user", "z" * 200_000)]
    rows += [(950, k, "user", f"turn {k % 3}") for k in range(500)] + [(951, k, "user", f"turn {k % 3}") for k in range(495)]
    spark.createDataFrame(rows, DDL).withColumns({"_c": F.lit("c"), "_d": F.lit(1)}).write.parquet(f"{tmp_path}/conversations.parquet")
    expected = all_nodes(rows)
    got = prefixtrie.op12_prefix_trie(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = duckdb.sql(prefixtrie.ORACLE)
    assert found.columns == got.columns and sorted(found.fetchall(), key=str) == sorted(expected, key=str)


def test_ids_of_one_node_are_hashed_in_pieces(spark):
    ends = spark.createDataFrame([(1, 2, 3, c) for c in range(-5, 2000)] + [(4, 5, 6, 9), (1, 2, 4, 8)], "_d long, _p long, _q long, _c long").repartition(5)
    got = {(r["_d"], r["_p"], r["_q"]): (r["_ends"], r["_n_ends"]) for r in prefixtrie._ids_hashed(ends, 3).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 2, 3): (sha(range(-5, 2000)), 2005), (4, 5, 6): (sha([9]), 1), (1, 2, 4): (sha([8]), 1)}


def test_empty_table_and_turnless_conversations(spark):
    none = spark.createDataFrame([], DDL)
    assert prefixtrie.prefix_nodes(prefixtrie.turns_of(none)).count() == 0
    ids = [101, 102, 103]  # five turns come from a base that isn't there, so that nothing is left of one turn
    turns = prefixtrie.turns_of(spark.createDataFrame([(c, 0, "user", "t") for c in ids], DDL))
    rows = prefixtrie.prefix_nodes(prefixtrie.rebuilt(turns, F.lit(5), F.lit(-1).cast("long"), 5)).collect()
    assert [tuple(r) for r in rows] == [(ids[0], 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]
