"""N-gram Jaccard join of whole documents by T-occurrence search.

A document is the set of its distinct ``shingle``-word shingles.  Two documents
with sets of a and b shingles link when 100 * overlap >= percent * union.  Any
partner shares at least T = ceil(percent/100 * a) of a document's shingles.
DivideSkip: of a document's a inverted lists the T-COMMON longest are set aside, so
that every partner occurs at least COMMON times in the lists that remain (all of
its times, where T is smaller).  Those short lists are merged by a shuffle on the
shingle; the lists set aside are probed afterwards, by binary search in the
candidate's sorted set, for the full overlap.  Which lists are long is decided by
one order for the whole corpus: by the magnitude of the number of documents that
have the shingle, from a sketch of all shingles of all documents, then by hash.
The sketch is never too low, so a shingle that it counts once is in no second
document and its list is left out at once.  The sketch holds at most 2**29 cells;
on corpora of many more shingles it tells small counts apart less well, which
costs time and never a link.

Merging a list of k documents emits no k*k pairs.  Sets that are equal are one
set from the start.  Each list first proposes two hubs, and every document is compared
to two of those its lists propose; links found make components, and afterwards only pairs of members
in different components remain to be compared: members outside a list's largest
component first against drawn members of it, then, where still apart, against the
rest, pairs with too few common short lists left out, the nearest pair of two
components first.  A pair inside one component cannot change
the result.  Lists carry ids, sizes and the signatures of up to
SIGNATURE words; wider ones are fetched for the pairs that remain.  Parity signatures of half a bit and more for each shingle (512 at
least), whose distance never exceeds the true set difference, rule pairs out before their sets are fetched.

Results: ``components`` gives one row per document.  Null or empty texts and
texts without words have no shingles and link with nothing; fewer words than a
shingle make one shingle of the whole.  Rows of equal id are one document that
has the links of all its texts; each row keeps its own n_shingles.  Null ids get
a null component and link nothing.  Other columns are not looked at.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.llm.common import discard, table, written
from tallyweir.llm.sketch import Bitmap, Frequencies, frequencies, sketch
from tallyweir.llm.wordhash import WordHasher, pieces, run_documents, run_hashes, table_map

SHINGLE, PERCENT = 4, 85
SIGNATURE = 8  # 64-bit words
#: Short lists that linked documents have in common at least.
COMMON = 4
#: For the sketch's size only.
CHARACTERS_PER_WORD = 6
#: Times that documents outside a list's largest component are compared to a member of it, before all that is left is.
ROUNDS = 2


def _sets(h: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of the distinct shingles, sorted by both."""
    places, doc = run_documents(ends, k)
    shingles = run_hashes(h, k)[places] if len(places) else np.zeros(0, dtype=np.uint64)
    lengths = np.diff(ends)
    short = np.flatnonzero((lengths > 0) & (lengths < k))  # the whole sequence is the shingle; marked with its length
    if len(short):
        x = [run_hashes(h[ends[d] : ends[d + 1]], int(lengths[d]))[0] ^ np.uint64(lengths[d] * 0x9E3779B1) for d in short]
        shingles, doc = np.concatenate((shingles, np.array(x, dtype=np.uint64))), np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        shingles, doc = shingles[order], doc[order]
    edges = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True]))).tolist() if len(doc) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        shingles[a:b].sort()
    if len(doc):
        new = np.concatenate(([True], (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])))
        shingles, doc = shingles[new], doc[new]
    return doc, shingles


def _shingles(k: int):
    def entries(batches):
        for _, h, ends in pieces(batches, WordHasher(lower=True)):
            yield _sets(h, ends, k)[1]

    return entries


def short_lists(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """How many lists stay when the T-COMMON longest of n are set aside, T = ceil(percent * n / 100)."""
    return np.minimum(n - (-(-percent * n // 100)) + COMMON, n)


def _profiles(k: int, percent: int, seen: Frequencies):
    def run(batches):
        hasher = WordHasher(lower=True)
        for batch, h, ends in pieces(batches, hasher):
            doc, s = _sets(h, ends, k)
            often = seen.of(s)
            n = np.bincount(doc, minlength=len(ends) - 1)
            start = np.concatenate(([0], np.cumsum(n)))
            # sorted by hash within each document already
            order = np.argsort((doc << 4) + often, kind="stable")
            inside = np.arange(len(s)) - start[doc]
            short = order[(inside < short_lists(n, percent)[doc]) & (often[order] > 0)]
            short_n = np.bincount(doc[short], minlength=len(n))
            # bits of the signature: SIGNATURE words for sets of up to 1024, twice as many for twice the size
            wide = SIGNATURE << np.maximum(np.ceil(np.log2(np.maximum(n, 1) / 1024)), 0).astype(np.int64)
            ends_of = np.concatenate(([0], np.cumsum(wide)))
            bits = (s * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(24)).astype(np.int64) % (wide * 64)[doc]
            at_bit, times = np.unique(ends_of[doc] * 64 + bits, return_counts=True)
            flat = np.zeros(int(ends_of[-1]) * 64, dtype=np.uint8)
            flat[at_bit] = times & 1
            signature = np.packbits(flat, bitorder="little").view(np.int64)
            raw = s.tobytes()
            digest = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
            pos = np.concatenate(([0], np.cumsum(short_n))).astype(np.int32)
            yield {
                "_id": batch.column("_id"),
                "_n": pa.array(n.astype(np.int64)),
                "_digest": pa.array(digest, pa.binary()),
                "_sig": pa.ListArray.from_arrays(pa.array(ends_of.astype(np.int32)), pa.array(signature)),
                "_short": pa.ListArray.from_arrays(pa.array(pos), pa.array(s[short].view(np.int64))),
            }

    return table_map(run)


def _short_entries(batches):
    for batch in batches:
        yield batch.column("_short").flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _short_repeated(bitmap: Bitmap):
    """Leaves in ``_short`` the shingles that another document may have there too."""

    def run(batches):
        for batch in batches:
            short = batch.column("_short")
            flat = short.flatten().to_numpy(zero_copy_only=False)
            hit = bitmap.hits(flat.view(np.uint64))
            doc = np.repeat(np.arange(len(short)), np.diff(short.offsets.to_numpy()))
            pos = np.concatenate(([0], np.cumsum(np.bincount(doc[hit], minlength=len(short))))).astype(np.int32)
            yield {"_id": batch.column("_id"), "_n": batch.column("_n"), "_short": pa.ListArray.from_arrays(pa.array(pos), pa.array(flat[hit]))}

    return table_map(run)


def _id_entries(batches):
    for batch in batches:
        yield batch.column("_key").to_numpy(zero_copy_only=False).view(np.uint64)


def _full_sets(k: int, wanted: Bitmap):
    def chosen(batches):
        for batch in batches:
            hit = wanted.hits(batch.column("_key").to_numpy(zero_copy_only=False).view(np.uint64))
            if hit.any():
                yield batch.filter(pa.array(hit))

    def run(batches):
        hasher = WordHasher(lower=True)
        for batch, h, ends in pieces(chosen(batches), hasher):
            doc, s = _sets(h, ends, k)
            pos = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(ends) - 1)))).astype(np.int32)
            yield {"_id": batch.column("_id"), "_set": pa.ListArray.from_arrays(pa.array(pos), pa.array(s.view(np.int64)))}

    return table_map(run)


def _sets_of(rows: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(_id, _set) of the documents in ``pairs`` (and a few more, by a bitmap of ids): texts are not shuffled."""
    ends = pairs.select(F.explode(F.array("_x", "_y")).alias("_id")).select(F.xxhash64("_id").alias("_key"))
    wanted = sketch(ends, _id_entries, 2 * pairs.count(), least=1)
    schema = T.StructType([rows.schema["_id"], T.StructField("_set", T.ArrayType(T.LongType()))])
    sets = written(rows.where("_id is not null").withColumn("_key", F.xxhash64("_id")).mapInArrow(_full_sets(k, wanted), schema), "sets")
    wanted.close()
    return sets


def _apart(a: str, b: str) -> Column:
    """Distance of the signatures of the rows with prefixes a and b; never over the true set difference."""
    x, y = F.col(f"{a}sig"), F.col(f"{b}sig")
    short = functools.reduce(lambda p, q: p + q, [F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(SIGNATURE)])

    def folded(v: Column, n: Column) -> Column:  # a signature of twice the width becomes one of the other's
        half = F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, n + 1, n), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(v) == n * 2, half).otherwise(v)

    n = F.least(F.size(x), F.size(y))
    apart = F.zip_with(folded(x, n), folded(y, n), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    wide = F.aggregate(apart, F.lit(0), lambda p, q: p + q)
    # sizes that may link differ by one width at most; others are ruled out by size
    comparable = F.greatest(F.size(x), F.size(y)) <= n * 2
    return F.when((F.size(x) == SIGNATURE) & (F.size(y) == SIGNATURE), short).when(comparable, wide).otherwise(F.lit(0))


def _least_overlap(a: str, b: str, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (F.col(f"{a}n") + F.col(f"{b}n")) / F.lit(100 + percent))


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _may_link(a: str, b: str, percent: int) -> Column:
    """Sizes and signatures allow a link of the rows with prefixes a and b."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return _sizes_fit(a, b, percent) & (_apart(a, b) <= n + m - 2 * _least_overlap(a, b, percent))


def _linked(pairs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """The (_x, _y) of ``pairs`` that link, by probing the smaller set in the larger."""
    pairs = written(pairs, "pairs")
    sets = _sets_of(rows, pairs, k)

    @F.pandas_udf("boolean")
    def probe(a, b):
        import pandas as pd

        out = []
        for x, y in zip(a, b, strict=True):
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            small, large = np.asarray(small).view(np.uint64), np.asarray(large).view(np.uint64)
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
            out.append(both > 0 and 100 * both >= percent * (len(small) + len(large) - both))
        return pd.Series(out, dtype=bool)

    x = sets.select(F.col("_id").alias("_x"), F.col("_set").alias("_xs"))
    y = sets.select(F.col("_id").alias("_y"), F.col("_set").alias("_ys"))
    found = written(pairs.join(x, "_x").join(y, "_y").where(probe("_xs", "_ys")).select("_x", "_y").distinct(), "links")
    discard(sets, pairs)
    return found


def _mixed_lists(shared: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Members of lists with their components, and of each list with several its largest (_main) with a member (_hub) drawn anew each turn."""
    listed = shared.select("_s", F.col("_d").alias("_id"), F.col("_dn").alias("_n")).join(labels, "_id", "left").select("_s", "_id", "_n", F.coalesce("_label", "_id").alias("_label"))
    listed = written(listed, "listed")
    drawn = F.min(F.struct(F.xxhash64("_id", "_s", F.lit(turn)).alias("_hash"), "_id"))["_id"].alias("_hub")
    sizes = listed.groupBy("_s", "_label").agg(F.count("*").alias("_k"), drawn)
    mixed = sizes.groupBy("_s").agg(F.max(F.struct("_k", "_label", "_hub")).alias("_m"), F.count("*").alias("_labels")).where("_labels > 1")
    return listed, mixed.select("_s", F.col("_m._label").alias("_main"), F.col("_m._hub").alias("_hub"))


def _twins(members: DataFrame) -> DataFrame:
    """(_x, _y) between the classes of equal sets that one id's rows are in."""
    first = members.groupBy("_id").agg(F.min("_rep").alias("_x"), F.count("*").alias("_k")).where("_k > 1").select("_id", "_x")
    return members.join(first, "_id").where("_rep <> _x").select("_x", F.col("_rep").alias("_y")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(_id, _label): least id reachable, for every id in ``edges`` (_x, _y)."""
    both = written(edges.unionByName(edges.select(F.col("_y").alias("_x"), F.col("_x").alias("_y"))), "edges")
    labels = written(both.groupBy(F.col("_x").alias("_id")).agg(F.least(F.min("_y"), F.col("_x")).alias("_label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("_id", "_y"), "_y").groupBy(F.col("_x").alias("_id")).agg(F.min("_label").alias("_near"))
        jump = labels.select(F.col("_id").alias("_label"), F.col("_label").alias("_jump"))
        new = labels.join(near, "_id", "left").join(jump, "_label", "left")
        new = new.select("_id", F.least("_label", "_near", "_jump").alias("_new"), F.col("_label").alias("_old"))
        new = written(new, "labels")
        changed = new.where("_new < _old").limit(1).count()
        labels = new.select("_id", F.col("_new").alias("_label"))
        if not changed:
            return labels


def relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` (_id, _label) after the links ``found`` (_x, _y): only the components that these join are labelled anew."""
    of_x, of_y = (labels.select(F.col("_id").alias(c), F.col("_label").alias(f"{c}l")) for c in ("_x", "_y"))
    ends = found.join(of_x, "_x", "left").join(of_y, "_y", "left")
    ends = ends.select("_x", "_y", F.coalesce("_xl", "_x").alias("_p"), F.coalesce("_yl", "_y").alias("_q"))
    ends = written(ends, "ends")
    between = ends.where("_p <> _q").select(F.least("_p", "_q").alias("_x"), F.greatest("_p", "_q").alias("_y")).distinct()
    new = connected(between).select(F.col("_id").alias("_label"), F.col("_label").alias("_new"))
    # documents without a link before are components of their own
    known = labels.unionByName(ends.select(F.explode(F.array(F.struct(F.col("_x").alias("_id"), F.col("_p").alias("_label")), F.struct(F.col("_y").alias("_id"), F.col("_q").alias("_label")))).alias("_e")).select("_e.*")).distinct()
    return written(known.join(new, "_label", "left").select("_id", F.coalesce("_new", "_label").alias("_label")), "labels")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(``doc_id``, n_shingles, component_id): one row for each row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType
    words = (rows.agg(F.sum(F.length("_text"))).first()[0] or 0) / CHARACTERS_PER_WORD
    seen = frequencies(rows.select("_text"), _shingles(shingle), words)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("_id", kind), T.StructField("_n", T.LongType()), T.StructField("_digest", T.BinaryType()), T.StructField("_sig", longs), T.StructField("_short", longs)])
    profiles = written(rows.mapInArrow(_profiles(shingle, percent, seen), schema), "profiles")
    seen.close()

    named = profiles.where("_id is not null and _n > 0")
    same = written(named.groupBy("_digest", "_n").agg(F.min("_id").alias("_rep")), "equal-sets")
    # one member of each class of equal sets stands for it
    members = written(named.select("_id", "_digest", "_n").join(same.hint("merge"), ["_digest", "_n"]).select("_id", "_rep").distinct(), "members")
    reps = members.where("_id = _rep").select(F.col("_id").alias("_d")).distinct()
    # of the short lists only those that a sketch of all of them says have two members
    repeated = sketch(profiles.select("_short"), _short_entries, profiles.agg(F.sum(F.size("_short"))).first()[0] or 0)
    lists = T.StructType([T.StructField("_id", kind), T.StructField("_n", T.LongType()), T.StructField("_short", longs)])
    postings = named.select("_id", "_n", "_short").mapInArrow(_short_repeated(repeated), lists)
    postings = postings.select(F.explode("_short").alias("_s"), F.col("_id").alias("_d"), F.col("_n").alias("_dn"))
    postings = written(postings.join(reps.hint("merge"), "_d", "left_semi"), "postings")
    repeated.close()
    hubs = postings.groupBy("_s").agg(F.count("*").alias("_k"), F.min(F.struct("_dn", "_d")).alias("_h1"), F.min(F.struct(F.xxhash64("_d").alias("_hash"), "_d")).alias("_h2"))
    hubs = written(hubs.where("_k > 1").select("_s", F.col("_h1._d").alias("_h1"), F.col("_h2._d").alias("_h2")), "hubs")
    shared = written(postings.join(hubs.hint("merge"), "_s").select("_s", "_d", "_dn", "_h1", "_h2"), "shared-lists")
    discard(postings, hubs)
    # one hub by size and one by hash for each document, the least of those its lists have
    other = lambda c: F.when(F.col(c) != F.col("_d"), F.col(c))
    hub_of = shared.groupBy("_d").agg(F.min(other("_h1")).alias("_h1"), F.min(F.struct(F.xxhash64(other("_h2")).alias("_hash"), other("_h2").alias("_h2")))["_h2"].alias("_h2"))
    proposed = hub_of.select(F.col("_d").alias("_y"), F.explode(F.array("_h1", "_h2")).alias("_x")).where("_x is not null")
    proposed = proposed.select(F.least("_x", "_y").alias("_x"), F.greatest("_x", "_y").alias("_y")).distinct()
    involved = shared.select(F.col("_d").alias("_id")).distinct()
    signatures = named.select("_id", "_n", "_sig").join(involved.hint("merge"), "_id", "left_semi")
    signatures = written(signatures.distinct(), "signatures")
    counts = written(profiles.select("_id", "_n"), "sizes")
    discard(profiles, same)

    def side(name: str) -> DataFrame:
        return signatures.select(F.col("_id").alias(f"_{name}"), F.col("_n").alias(f"_{name}n"), F.col("_sig").alias(f"_{name}sig"))

    proposed = proposed.join(side("x"), "_x").join(side("y"), "_y").where(_may_link("_x", "_y", percent)).select("_x", "_y").distinct()
    links = _linked(proposed, rows, shingle, percent).unionByName(written(_twins(members), "twins"))
    labels = connected(links)

    # members outside a list's largest component are compared to one member of it for each list, others in each round
    for turn in range(ROUNDS):
        listed, mixed = _mixed_lists(shared, labels, turn)
        outside = listed.join(mixed.hint("merge"), "_s").where("_label <> _main").select(F.least("_id", "_hub").alias("_x"), F.greatest("_id", "_hub").alias("_y")).distinct()
        outside = outside.join(side("x"), "_x").join(side("y"), "_y").where(_may_link("_x", "_y", percent)).select("_x", "_y").distinct()
        found = _linked(outside, rows, shingle, percent)
        if not found.limit(1).count():
            break
        labels = relabelled(labels, found)

    # what is still in different components: those outside a list's largest component against all
    listed, mixed = _mixed_lists(shared, labels, 0)
    # shuffled once for both sides
    narrow = signatures.where(F.size("_sig") == SIGNATURE)
    signed = listed.join(narrow.hint("merge"), ["_id", "_n"], "left").repartition("_s")
    mixed = signed.join(mixed.drop("_hub").hint("merge"), "_s")
    x = mixed.where("_label <> _main").select("_s", "_main", F.col("_id").alias("_x"), F.col("_label").alias("_xl"), F.col("_n").alias("_xn"), F.col("_sig").alias("_xsig"))
    y = signed.select("_s", F.col("_id").alias("_y"), F.col("_label").alias("_yl"), F.col("_n").alias("_yn"), F.col("_sig").alias("_ysig"))
    across = (F.col("_xl") != F.col("_yl")) & ((F.col("_yl") == F.col("_main")) | (F.col("_x") < F.col("_y")))
    narrow_fit = F.col("_xsig").isNull() | F.col("_ysig").isNull() | _may_link("_x", "_y", percent)
    pairs = x.hint("merge").join(y, "_s").where(across & _sizes_fit("_x", "_y", percent) & narrow_fit)
    ends = F.struct(F.col("_x"), F.col("_xn"), F.col("_xl")), F.struct(F.col("_y").alias("_x"), F.col("_yn").alias("_xn"), F.col("_yl").alias("_xl"))
    pairs = pairs.select(F.least(*ends).alias("_a"), F.greatest(*ends).alias("_b")).select(
        "_a._x", "_a._xn", F.col("_a._xl").alias("_p"), F.col("_b._x").alias("_y"), F.col("_b._xn").alias("_yn"), F.col("_b._xl").alias("_q")
    )
    # each pair once for every short list that both are in
    pairs = pairs.groupBy("_x", "_xn", "_p", "_y", "_yn", "_q").agg(F.count("*").alias("_common"))
    pairs = written(pairs.where(F.col("_common") >= F.least(F.lit(COMMON), _least_overlap("_x", "_y", percent))), "common-lists")
    pairs = pairs.join(side("x"), ["_x", "_xn"]).join(side("y"), ["_y", "_yn"]).where(_may_link("_x", "_y", percent))
    pairs = pairs.select("_x", "_y", F.least("_p", "_q").alias("_p"), F.greatest("_p", "_q").alias("_q"), _apart("_x", "_y").alias("_apart"))
    pairs = written(pairs.distinct(), "cross-pairs")

    # of two components the nearest pair is probed first; where it links, their other pairs need no sets
    nearest = pairs.groupBy("_p", "_q").agg(F.min(F.struct("_apart", "_x", "_y")).alias("_best")).select("_best._x", "_best._y")
    found = _linked(nearest, rows, shingle, percent)
    if found.limit(1).count():
        labels = relabelled(labels, found)
    merged = labels.select(F.col("_id").alias("_p"), F.col("_label").alias("_pl")), labels.select(F.col("_id").alias("_q"), F.col("_label").alias("_ql"))
    left = pairs.join(merged[0], "_p", "left").join(merged[1], "_q", "left").where(F.coalesce("_pl", "_p") != F.coalesce("_ql", "_q"))
    left = written(left.select("_x", "_y").distinct().join(nearest, ["_x", "_y"], "left_anti"), "cross-pairs")
    if left.limit(1).count():
        more = _linked(left, rows, shingle, percent)
        if more.limit(1).count():
            labels = relabelled(labels, more)
    # classes of equal sets carry the label of the document that stands for them
    of_rep = members.join(labels.select(F.col("_id").alias("_rep"), F.col("_label")), "_rep", "left").select("_id", F.coalesce("_label", "_rep").alias("_label"))
    several = of_rep.groupBy("_id").agg(F.min("_label").alias("_label"))
    return counts.join(several, "_id", "left").select(
        F.col("_id").alias(doc_id), F.col("_n").alias("n_shingles"), F.coalesce("_label", "_id").alias("component_id")
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple], k: int = SHINGLE, percent: int = PERCENT) -> list[tuple]:
    """The same rows by comparing every pair; for small inputs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(j: int) -> int:
        while root[j] != j:
            j = root[j]
        return j

    for j in range(len(rows)):
        for m in range(j):
            both = len(sets[j] & sets[m])
            if both and 100 * both >= percent * len(sets[j] | sets[m]):
                root[find(j)] = find(m)
    least: dict[int, int] = {}
    for j, (d, _) in enumerate(rows):
        least[find(j)] = min(least.get(find(j), d), d)
    return [(d, len(sets[j]), least[find(j)]) for j, (d, _) in enumerate(rows)]
