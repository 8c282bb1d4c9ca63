"""Periodic runs of words, found while the words come in.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are
equal) of at least ``max(least, 2 q)`` words that no neighbouring word extends.
``SquareCatcher`` takes words by any number at a time.  Each completed block of
``K`` words, K a power of two and the block aligned to it, has a catcher: where
its words come again ``q`` words later, for the periods that belong to K, the
stretch of words equal to those ``q`` before them is followed to the left once
and then to the right with every word that is appended, until a word differs.  A
stretch of ``q`` equal pairs or more is a square, and squares of one stretch are
one run.  The periods of K are those for which any run holds one aligned block of
K in the part that comes again: ``2 K - 1 <= max(least - q, q)``.

Blocks are compared by hashes of K words, made of those of K / 2; each hash
match is then compared word by word, so results are exact.  Of a stretch only its
first block counts.  Blocks inside a run of a short period that reaches over both
places are passed over, as their period is a multiple; where two such runs hold
the places, the ends of the runs tell all their blocks' stretches at once.  Kept per word are
its number and some hashes: about 40 bytes, whatever the levels.

Null texts have no words and no runs; rows are independent of one another, so
repeated rows and ids get equal results.  The query takes a null id for an empty one where
it looks which texts to loop.  Very long texts go in pieces of
``PIECE`` words.  Empty tables give empty results.  Columns called ``runs`` and
``collapsed`` are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm.common import WORD, fresh, table

#: Least number of words of a run.
LEAST = 12
#: Words that go in at a time.
PIECE = 16_384

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(32)
_NONE = np.zeros(0, np.int64)


def _places(of: np.ndarray) -> np.ndarray:
    return of.nonzero()[0]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _B
    return h ^ (h >> _S)


class _Growing:
    """An array that values are appended to and whose beginning may be given up; places count from the very first value."""

    def __init__(self, dtype):
        self.a, self.first, self.end = np.empty(64, dtype), 0, 0

    def append(self, values: np.ndarray) -> None:
        n = self.end - self.first
        if n + len(values) > len(self.a):
            a = np.empty(max(2 * n, n + len(values)), self.a.dtype)
            a[:n] = self.a[:n]
            self.a = a
        self.a[n : n + len(values)] = values
        self.end += len(values)

    def forget(self, before: int) -> None:
        """Values before that place go, once they are half of all."""
        if before - self.first > (self.end - self.first) // 2:
            self.a = self.a[before - self.first : self.end - self.first].copy()
            self.first = before

    def at(self, places) -> np.ndarray:
        return self.a[places - self.first]

    def part(self, lo: int, hi: int) -> np.ndarray:
        return self.a[lo - self.first : hi - self.first]


@lru_cache(maxsize=4096)
def periods_of(k: int, least: int) -> list[tuple[int, int]]:
    """Intervals of the periods that blocks of ``k`` words catch."""
    def level(q: int) -> int:
        return 1 << ((max(least - q, q) + 1) // 2).bit_length() - 1

    mine = [q for q in range(1, min(least, 4 * k) + 1) if level(q) == k]
    out = []
    for q in mine:
        out = [*out[:-1], (out[-1][0], q)] if out and out[-1][1] == q - 1 else [*out, (q, q)]
    rest = max(2 * k - 1, least + 1)
    if rest <= 4 * k - 2:
        out = [*out[:-1], (out[-1][0], 4 * k - 2)] if out and out[-1][1] == rest - 1 else [*out, (rest, 4 * k - 2)]
    return out


class _Catchers:
    """Those over the blocks of one length: the blocks' hashes, and the latest windows' ones."""

    def __init__(self, k: int, least: int):
        self.k, self.shift, self.periods = k, k.bit_length() - 1, periods_of(k, least)
        self.blocks, self.windows = _Growing(np.uint64), _Growing(np.uint64)

    def add(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows that the new words complete; returns starts and periods of blocks that come again, first blocks of their stretches only."""
        k, lo = self.k, self.windows.end
        self.windows.append(hashes)
        self.blocks.append(hashes[-lo % k :: k])
        blocks, periods = [], []
        for q0, q1 in self.periods:
            for back in range(-((q0 - q1 - 1) // k)):
                first = max(lo, q0 + back * k)
                if first >= self.windows.end:
                    break
                m = (np.arange(first - q0, self.windows.end - q0) >> self.shift) - back
                at = (self.blocks.at(m) == hashes[first - lo :]).nonzero()[0]
                if len(at):
                    at, m = at + first, m[at]
                    near = at - m * k <= q1
                    blocks.append(m[near])
                    periods.append(at[near] - m[near] * k)
        if not blocks:
            return _NONE, _NONE
        m, q = np.concatenate(blocks), np.concatenate(periods)
        new = m == 0
        again = (~new).nonzero()[0]
        new[again] = self.blocks.at(m[again] - 1) != self.windows.at((m[again] - 1) * k + q[again])
        return m[new] * k, q[new]


class SquareCatcher:
    """``append`` words, given as whole numbers; ``runs`` are those of the words so far."""

    def __init__(self, least: int = LEAST):
        self.least, self.x, self.n = least, _Growing(np.int64), 0
        self.levels: list[_Catchers] = [_Catchers(1, least)]
        self.closed: dict[tuple[int, int], int] = {}  # (start, end): smallest period
        self.open: set[tuple[int, int]] = set()  # (start, period) of stretches that reach the last word
        self.waiting: dict[tuple[int, int], list] = {}  # blocks that lie in a run and again in an open one: its end decides on them at once

    def append(self, words: np.ndarray) -> None:
        if not len(words):
            return
        old, self.n = self.n, self.n + len(words)
        self.x.append(words)
        for (s, q) in list(self.open):
            self._follow(s, q, old)
        hashes = _mix(words.astype(np.uint64) * _A + _C)
        for level in self.levels:
            starts, periods = level.add(hashes)
            if len(starts):
                self._caught(level.k, starts, periods)
            k, w = level.k, level.windows
            if level is self.levels[-1]:
                if w.end <= k:
                    break
                self.levels.append(_Catchers(2 * k, self.least))  # the loop goes on with it
            lo = self.levels[level.shift + 1].windows.end
            hi = max(lo, w.end - k)
            with np.errstate(over="ignore"):
                hashes = _mix(w.part(lo, hi) * _A + _mix(w.part(lo + k, hi + k) + _C))
            w.forget(w.end - 3 * k)
            if not len(hashes):
                break

    def _known(self, k: int) -> np.ndarray | None:
        """(start, end, period or 0 if closed) of the runs with periods of at most k / 2, by start; each row is that of the runs up to there that ends last."""
        runs = [(s, e, 0) for (s, e), q in self.closed.items() if 2 * q <= k]
        runs += [(s, self.n, q) for s, q in self.open if 2 * q <= k and self.n - s >= max(2 * q, self.least)]
        if not runs:
            return None
        runs = np.array(sorted(runs))
        best = np.maximum.accumulate(runs[:, 1])
        of = np.maximum.accumulate(np.where(runs[:, 1] == best, np.arange(len(runs)), 0))
        return np.column_stack([runs[:, 0], runs[of]])

    def _caught(self, k: int, i: np.ndarray, q: np.ndarray) -> None:
        """Blocks of k words at i that come again q words later."""
        known = self._known(k)
        if known is not None:
            one, two = (known[np.maximum(np.searchsorted(known[:, 0], at, "right") - 1, 0), 1:] for at in (i, i + q))
            inside = lambda run, at: (run[:, 0] <= at) & (run[:, 1] >= at + k)
            both = inside(one, i) & inside(two, i + q)
            # one run with a short period over both: q is a multiple of it
            over = both & (one[:, 1] >= i + q + k)
            # two runs with one short period that don't begin q apart: the stretch is what they share, unless they end q apart
            short = both & ~over & (one[:, 0] + q != two[:, 0]) & (np.minimum(i - one[:, 0], i + q - two[:, 0]) + one[:, 1] - i < q)
            later = short & (two[:, 2] > 0) & (one[:, 1] + q >= two[:, 1])
            for at in np.unique(two[later], axis=0):
                mine = later & (two == at).all(1)
                self.waiting.setdefault((int(at[0]), int(at[2])), []).append((k, i[mine], q[mine], one[mine, 1]))
            keep = ~over & ~(short & ((two[:, 2] > 0) | (one[:, 1] + q != two[:, 1])))
            i, q = i[keep], q[keep]
        for at, period in zip(i.tolist(), q.tolist(), strict=True):
            self._caught_one(k, at, period)

    def _caught_one(self, k: int, at: int, period: int) -> None:
        """Follows the stretch around one block to the left, then to the right."""
        x, hi = self.x, at + period
        if not np.array_equal(x.part(at, at + k), x.part(hi, hi + k)):
            return
        start, step = at, k
        while start:
            take = min(step, start)
            differ = _places(x.part(start - take, start) != x.part(start - take + period, start + period))
            if len(differ):
                start += int(differ[-1]) + 1 - take
                break
            start, step = start - take, 2 * step
        if (start, period) not in self.open:
            self._follow(start, period, hi + k)

    def _follow(self, start: int, q: int, at: int) -> None:
        """Compares words from ``at`` on with those q before, until one differs or there are no more yet."""
        step = 64
        while at < self.n:
            hi = min(at + step, self.n)
            differ = _places(self.x.part(at, hi) != self.x.part(at - q, hi - q))
            if len(differ):
                end = at + int(differ[0])
                self.open.discard((start, q))
                if end - start >= max(self.least, 2 * q):
                    self.closed[start, end] = min(q, self.closed.get((start, end), q))
                for k, i, periods, first_end in self.waiting.pop((start, q), ()):
                    mine = first_end + periods == end
                    for place, period in zip(i[mine].tolist(), periods[mine].tolist(), strict=True):
                        self._caught_one(k, place, period)
                return
            at, step = hi, 2 * step
        self.open.add((start, q))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run of the words so far, by start, then period."""
        found = dict(self.closed)
        for s, q in self.open:
            if self.n - s >= max(self.least, 2 * q):
                found[s, self.n] = min(q, found.get((s, self.n), q))
        return sorted((s, e - s, q) for (s, e), q in found.items())


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def find_runs(words: list[bytes], least: int = LEAST, piece: int = PIECE) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words."""
    if len(words) < least:
        return []
    x, catcher = np.fromiter(map(_Numbers().__getitem__, words), np.int64, len(words)), SquareCatcher(least)
    for lo in range(0, len(x), piece):
        catcher.append(x[lo : lo + piece])
    return catcher.runs()


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what runs repeat: of each run its first period stays, unless another run repeats it."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in _places(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, text: Column | str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``runs``, by start, then period, and ``collapsed``: the words that no run repeats, joined by one space."""
    name = fresh(docs, "_words_of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            found, kept = [], []
            for value in batch.column(name):
                words = (value.as_py() or b"").split()
                runs = find_runs(words, least)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                kept.append(b" ".join(collapse(words, runs)))
            rest = [k for k, c in enumerate(batch.schema.names) if c != name]
            columns = [batch.column(k) for k in rest] + [pa.array(found, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[k] for k in rest), "runs", "collapsed"])

    rest = docs.drop("runs", "collapsed")
    given = rest.select("*", (docs[text] if isinstance(text, str) else text).cast("binary").alias(name)) if text not in ("runs", "collapsed") else docs.withColumn(name, docs[text].cast("binary")).drop("runs", "collapsed")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    out = given.mapInArrow(run, f"{fields + ', ' if fields else ''}runs {RUNS}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def looped(docs: DataFrame) -> DataFrame:
    """Documents of which the id's crc32 is a multiple of 10 are made to repeat their end over and over; all others stay."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op13_dyadic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all whole documents, the longest of each, and what stays without repeats."""
    found = periodic_runs(looped(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    of = found.select("doc_id", "runs", "collapsed", longest.alias("best"), line.alias("lines"))
    return of.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.floor(-F.col("best.l") * 1000 / F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
