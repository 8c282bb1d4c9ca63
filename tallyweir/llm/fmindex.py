"""Benchmark decontamination with an FM-index per shard of training text.

A shard is one Arrow batch of documents.  Its words become symbols: words that
no benchmark phrase holds cannot be part of a match, so the text is cut there
and runs shorter than the shortest phrase are left out; nothing else is.  Over
the runs that remain the shard gets a suffix order, its Burrows-Wheeler
transform in a wavelet tree with rank directories, and suffix positions sampled
every ``SAMPLE`` symbols.  All phrases are searched backwards at once; each hit
is located by walking to a sampled position, and hits become removal spans.

The phrases are broadcast in blocks of at most ``max_block_words`` words; a
larger benchmark takes several passes whose spans are merged, so what is
broadcast is bounded whatever the size of the benchmark.

Null and empty texts have no words and are never contaminated.  Repeated rows
get the same result each.  An empty benchmark hits nothing.  Items with the
same id count once; items with a null id hit words but are not listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm.common import fresh, table, written

WINDOW = 13
SAMPLE = 8
#: Words that one broadcast block of phrases may hold.
MAX_BLOCK_WORDS = 2_000_000

#: Lower-cases A-Z and turns every byte that is in no word into a space; bytes
#: of 0x80 and above are parts of words.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if (b >= 128 or chr(b).isalnum()) else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class WaveletTree:
    """Ranks of symbols 0..sigma-1 in a sequence, level by level."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ranks: list[np.ndarray] = []  # ones before each place, per level
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bits = (seq >> level) & 1
            self.ranks.append(np.concatenate(([0], np.cumsum(bits, dtype=np.int64))).astype(np.int32))
            self.zeros.append(int(len(seq) - bits.sum()))
            seq = np.concatenate((seq[bits == 0], seq[bits == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        lo, hi = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ranks, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit == 1, zeros + a, lo - a), np.where(bit == 1, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ranks, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            out = (out << 1) | bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Over runs of symbols >= 1; 0 ends each run and is sorted by position."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        order = self._suffixes(text)
        self.bwt = text[order - 1]
        self.tree = WaveletTree(self.bwt, sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma)))).astype(np.int64)
        start = np.ones(n, dtype=bool)
        start[1:] = text[:-1] == 0
        sampled = start | (np.arange(n) % SAMPLE == 0)
        self.marked = sampled[order]
        self.mark_rank = np.concatenate(([0], np.cumsum(self.marked)))
        self.positions = order[self.marked]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; run ends compare by position."""
        n, ends = len(text), np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        order = np.argsort(rank, kind="stable")
        step = 1
        while True:
            sorted_rank = rank[order]
            dense = np.empty(n, dtype=np.int64)
            dense[order] = np.concatenate(([0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])))
            if dense[order[-1]] == n - 1:
                return order
            nxt = np.full(n, -1, dtype=np.int64)
            nxt[:-step] = dense[step:]
            rank = dense * (n + 1) + nxt + 1
            order = np.argsort(rank, kind="stable")
            step *= 2

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each row's first ``lengths`` symbols."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), len(self.bwt), dtype=np.int64)
        for back in range(1, int(lengths.max()) + 1 if len(lengths) else 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back].astype(np.int64)
            lo[live] = self.first[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.tree.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of places in the suffix order."""
        rows, out, walked = rows.copy(), np.full(len(rows), -1, dtype=np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            done = self.marked[rows[todo]]
            out[todo[done]] = self.positions[self.mark_rank[rows[todo[done]]]] + walked
            todo = todo[~done]
            symbol = self.tree.access(rows[todo])
            rows[todo] = self.first[symbol] + self.tree.rank(symbol, rows[todo])
            walked += 1
        return out


class Phrases:
    """The distinct windows of a block of benchmark items, as symbols."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.symbol: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        self.ids: list[str] = []
        number: dict[str, int] = {}
        for item, text in items:
            w = [self.symbol.setdefault(x, len(self.symbol) + 1) for x in words(text)]
            for k in range(max(1, len(w) - window + 1) if w else 0):
                own = owners.setdefault(tuple(w[k : k + window]), set())
                if item is not None:
                    if item not in number:
                        number[item] = len(self.ids)
                        self.ids.append(item)
                    own.add(number[item])
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(x) for x in owners], dtype=np.int64)
        self.shortest = int(self.lengths.min()) if len(owners) else 0
        self.rows = np.zeros((len(owners), window), dtype=np.int32)
        for k, x in enumerate(owners):
            self.rows[k, : len(x)] = x

    def hits(self, texts: list[str | None]) -> list[tuple[int, list[list[int]], list[str]]]:
        """For each text of a shard: number of words, merged [start, end) spans, ids of items."""
        counts, runs, home, begin, at = [], [], [], [], 0
        for d, text in enumerate(texts):
            w = words(text)
            counts.append(len(w))
            if len(w) < max(self.shortest, 1) or not self.symbol:
                continue
            get = self.symbol.get
            s = np.fromiter((get(x, 0) for x in w), dtype=np.int32, count=len(w))
            known = np.flatnonzero(np.diff(np.concatenate(([0], (s > 0).view(np.int8), [0]))))
            for a, b in zip(known[::2], known[1::2], strict=True):
                if b - a >= self.shortest:
                    runs += [s[a:b], np.zeros(1, dtype=np.int32)]
                    home.append(d)
                    begin.append((at, a))
                    at += b - a + 1
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[int]] = [set() for _ in texts]
        if runs:
            index = FMIndex(np.concatenate(runs), len(self.symbol) + 1)
            lo, hi = index.search(self.rows, self.lengths)
            found = np.repeat(np.arange(len(lo)), hi - lo)
            inside = np.arange(len(found)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            place = index.locate(lo[found] + inside)
            starts = np.array([x[0] for x in begin])
            run = np.searchsorted(starts, place, side="right") - 1
            for p, r, q in zip(found.tolist(), run.tolist(), place.tolist(), strict=True):
                d, a = home[r], q - begin[r][0] + begin[r][1]
                spans[d].append((int(a), int(a + self.lengths[p])))
                items[d].update(self.owners[p])
        return [(n, merge_spans(s), sorted(self.ids[k] for k in i)) for n, s, i in zip(counts, spans, items, strict=True)]


def merge_spans(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


HITS = "struct<n_words: bigint, spans: array<array<int>>, items: array<string>>"


def blocks_of(benchmark: DataFrame, item_id: str, text: str, max_words: int) -> Iterator[list[tuple]]:
    """The benchmark in lists of at most ``max_words`` words (or one item)."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text)).orderBy(F.col(item_id).cast("string"), F.col(text))
    for item, body in rows.toLocalIterator():
        n = len(words(body))
        if block and size + n > max_words:
            yield block
            block, size = [], 0
        block.append((item, body))
        size += n
    yield block


def benchmark_hits(text: Column, block: list[tuple], spark: SparkSession, window: int = WINDOW) -> Column:
    """Column of ``HITS`` for one block of the benchmark."""
    phrases = spark.sparkContext.broadcast(Phrases(block, window))

    @F.pandas_udf(HITS)
    def find(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(phrases.value.hits([x if isinstance(x, str) else None for x in s]), columns=["n_words", "spans", "items"])

    return find(text)


def _merged(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    rows = [(n, merge_spans([list(x) for x in [*s, *t]]), sorted({*i, *j})) for n, s, i, t, j in zip(a.n_words, a.spans, a["items"], b.spans, b["items"], strict=True)]
    return pd.DataFrame(rows, columns=["n_words", "spans", "items"])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "hits",
    window: int = WINDOW,
    max_block_words: int = MAX_BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, spans of hit words, ids of items; a column of that name is replaced."""
    spark, first, more = docs.sparkSession, True, fresh(docs, "_more_hits")
    for block in blocks_of(benchmark, item_id, item_text, max_block_words):
        now = benchmark_hits(F.col(text), block, spark, window)
        if first:
            docs = docs.withColumn(out, now)
        else:  # one more pass for each further block; spans of all are merged
            docs = written(docs, "hits").withColumn(more, now).withColumn(out, F.pandas_udf(_merged, HITS)(F.col(out), F.col(more))).drop(more)
        first = False
    return docs


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]).cast("long"))


def contaminated(hits: Column) -> Column:
    return (n_hit(hits) > 0) & (n_hit(hits) * 20 >= hits["n_words"])


def op7_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.col("hits")
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        h["n_words"].alias("n_words"),
        n_hit(h).alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(h).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
