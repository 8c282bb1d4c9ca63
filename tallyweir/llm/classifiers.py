"""Toxicity and quality classifiers that learn from labelled documents.

Both fit on at most ``max_rows`` labelled rows (the ones with the least hash of
their id; a documented bound), whose hashed features alone reach the driver, and
then score every whole text where it lies.  Labels, language, source and id are
never inputs of a score.

* Toxicity: a factorization machine over hashed terms.  Terms are lower-cased
  words and their first four and five letters; each term of a document is
  active once.  Beside a weight every bucket has a ``FACTORS``-vector, whose
  inner products weigh pairs of terms, as an insult with a group's name.  Every
  bucket of ``LEAST_DOCUMENTS`` or more is in the machine, telling alone or not: at
  each step weights shrink towards 0, and vectors towards where they started, by
  ``chance`` (``chance_v``) times what a bucket as frequent drifts by chance; how strongly, and how fast
  vectors learn, is chosen by cross-validation.  Sums are scaled and shifted so
  that the threshold lies at the best cut of it, then squashed to scores.
* Quality: Naive Bayes support vectors.  N-gram indicators of one and two tokens
  (words, runs of symbols, marks for capitals, repetition and repeated lines)
  are scaled by the log-ratio of their class counts; a linear hinge-loss model
  is fitted to four fifths of the rows by dual coordinate descent, and a logistic curve on
  the margins of the last fifth turns margins into scores.

Null and empty texts have no features and get the score of the bias.  Without
labelled rows, or with one class only, scores are the (smoothed) share of class
1.  Rows of equal id are scored each; a label that occurs twice counts once, the
larger value.  Rows whose label is null are not learned from.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm.common import remainder, table

MAX_ROWS, THRESHOLD = 6_000, 0.7
BUCKET_BITS, FACTORS, LEAST_DOCUMENTS = 22, 4, 3
#: Rates of the vectors and how strongly chance holds them back, to be chosen from by ``FOLDS`` folds.
STRENGTHS, FOLDS = ({"rate_v": 0.024, "chance_v": 3.0}, {"rate_v": 0.03, "chance_v": 6.0}), 3

#: Tokens whose hashes a worker remembers, for each of two uses; about 50 MB.
REMEMBERED = 250_000

_LETTERS = re.compile(r"[^\W\d_]+")
_TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def toxicity_terms(text: str | None) -> set[str]:
    found = set(_LETTERS.findall(text.lower())) if text else set()
    return found | {w[:4] + "*" for w in found if len(w) > 4} | {w[:5] + "**" for w in found if len(w) > 5}


def _bucket(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) >> (64 - BUCKET_BITS)


def toxicity_buckets(text: str | None) -> np.ndarray:
    return np.unique(np.fromiter(map(_bucket, toxicity_terms(text)), dtype=np.int32))


class _Hashes(dict):
    """Hash of each token by ``of``, remembered while the vocabulary stays small."""

    def __init__(self, of: Callable[[str], str]):
        self.of = of

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(self.of(token))
        return value


_LOWER = _Hashes(str.lower)
_MARKED = _Hashes(lambda t: "\x01caps" if len(t) > 1 and t.isupper() else t.lower())


def forget() -> None:
    """Frees the remembered hashes: Python workers outlive their tasks and serve other stages."""
    _LOWER.clear()
    _MARKED.clear()


_SAME, _LINE = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in ("\x01same", "\x01line"))


def quality_buckets(text: str | None) -> np.ndarray:
    """Buckets of a text's one- and two-token n-grams and marks."""
    if not text:
        return np.zeros(0, dtype=np.int32)
    tokens = _TOKENS.findall(text)
    low, one = (np.fromiter(map(h.__getitem__, tokens), dtype=np.uint64, count=len(tokens)) for h in (_LOWER, _MARKED))
    one[1:][low[1:] == low[:-1]] = _SAME
    with np.errstate(over="ignore"):
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    lines = [x for x in text.split("\n") if x.strip()]
    marks = [np.uint64(xxhash.xxh3_64_intdigest(f"\x01length {len(tokens).bit_length()}")), *([_LINE] if len(lines) > len(set(lines)) else [])]
    return np.unique((np.concatenate((one, two, marks)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, buckets: Callable, max_rows: int, doc_id: str = "doc_id", text: str = "text") -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(buckets of all rows, first of each row and the end) and labels, of at most ``max_rows`` labelled documents."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & learn)
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)

    @F.pandas_udf("array<int>")
    def features(s: pd.Series) -> pd.Series:
        try:
            return s.map(lambda t: buckets(t if isinstance(t, str) else None), na_action=None)
        finally:
            forget()

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")  # max_rows at most
    rows = rows.select("_id", "_y", features("_text").alias("_x")).groupBy("_id").agg(F.min("_y").alias("_y"), F.min("_x").alias("_x"))
    got = rows.toArrow().sort_by("_id").combine_chunks()
    x = got.column("_x").combine_chunks()
    if not len(x):
        return (np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)), np.zeros(0)
    x = x.chunk(0) if hasattr(x, "chunk") else x
    offsets = x.offsets.to_numpy().astype(np.int64)
    return (x.flatten().to_numpy(), offsets - offsets[0]), got.column("_y").to_numpy().astype(np.float64)


def _frequent(x: tuple[np.ndarray, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets in so many documents, flat positions of them, offsets of the rows)."""
    flat, offsets = x
    buckets, n = np.unique(flat, return_counts=True)
    buckets = buckets[n >= least]
    at = np.minimum(np.searchsorted(buckets, flat), max(len(buckets) - 1, 0)).astype(np.int32)
    kept = buckets[at] == flat if len(buckets) else np.zeros(len(flat), dtype=bool)
    before = np.concatenate(([0], np.cumsum(kept)))
    return buckets, at[kept], before[offsets]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _curve(m: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to classes, by Newton steps with a little ridge."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        s = _sigmoid(slope * m + shift)
        g = np.array([((s - t) * m).sum() + 1e-2 * slope, (s - t).sum()])
        r = s * (1 - s) + 1e-6
        h = np.array([[(r * m * m).sum() + 1e-2, (r * m).sum()], [(r * m).sum(), r.sum()]])
        d = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(d[0], -2, 2), shift - np.clip(d[1], -2, 2)
    return float(slope), float(shift)


class FactorizationMachine:
    """bias + sum w_i + sum over pairs <v_i, v_j>, for the active buckets."""

    def __init__(self, x: tuple[np.ndarray, np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.2, rate_v: float = 0.02, l2: float = 1e-5, chance: float = 0.7, chance_v: float = 3.0, damp_w: float = 1e-4, damp_v: float = 1e-3, seed: int = 1):
        self.buckets, flat, offsets = _frequent(x, LEAST_DOCUMENTS)
        n, rng = len(self.buckets), np.random.default_rng(seed)
        share = (y.sum() + 1) / (len(y) + 2)
        self.bias, self.w, self.v = float(np.log(share / (1 - share))), np.zeros(n), rng.normal(0, 0.01, (n, FACTORS))
        self.slope, self.shift = 1.0, 0.0
        if not n or len(np.unique(y)) < 2:
            return
        times = np.bincount(flat, minlength=n)
        batches = -(-len(y) // batch)
        # what a bucket's gradient is by chance, for each batch that touches it
        spread = np.sqrt(share * (1 - share) * times) / (batch * np.maximum(batches * (1 - (1 - 1 / batches) ** times), 1))
        far, start = chance_v * 0.01 * np.sqrt(len(flat) / len(y)), self.v.copy()
        gw, gv, gb = np.full(n, damp_w), np.full((n, FACTORS), damp_v), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(y), batch):
                rows = order[s : s + batch]
                lengths = offsets[rows + 1] - offsets[rows]
                at = np.concatenate([flat[offsets[r] : offsets[r + 1]] for r in rows])
                row = np.repeat(np.arange(len(rows)), lengths)
                vx = self.v[at]
                sums = np.stack([np.bincount(row, weights=vx[:, f], minlength=len(rows)) for f in range(FACTORS)], axis=1)
                z = self.bias + np.bincount(row, weights=self.w[at], minlength=len(rows)) + 0.5 * ((sums**2).sum(1) - np.bincount(row, weights=(vx**2).sum(1), minlength=len(rows)))
                err = (_sigmoid(z) - y[rows]) / len(rows)
                touched, local = np.unique(at, return_inverse=True)
                dw = np.bincount(local, weights=err[row]) + l2 * self.w[touched]
                gw[touched] += dw**2
                step = rate / np.sqrt(gw[touched])
                w = self.w[touched] - step * dw
                self.w[touched] = np.sign(w) * np.maximum(np.abs(w) - step * chance * spread[touched], 0)
                pull = err[row][:, None] * (sums[row] - vx)
                dv = np.stack([np.bincount(local, weights=pull[:, f]) for f in range(FACTORS)], axis=1) + l2 * self.v[touched]
                gv[touched] += dv**2
                step = rate_v / np.sqrt(gv[touched])
                v = self.v[touched] - step * dv - start[touched]
                self.v[touched] = start[touched] + np.sign(v) * np.maximum(np.abs(v) - step * far * spread[touched, None], 0)
                db = err.sum()
                gb += db**2
                self.bias -= rate * db / np.sqrt(gb)

    def margin(self, at: np.ndarray) -> float:
        """For the active places of ``buckets``."""
        s = self.v[at].sum(0)
        return float(self.bias + self.w[at].sum() + 0.5 * ((s**2).sum() - (self.v[at] ** 2).sum()))

    def placed(self, margins: np.ndarray, y: np.ndarray, false_cost: int = 4) -> FactorizationMachine:
        """This machine with scores moved so that ``THRESHOLD`` lies at the best cut of the margins that rows got from other rows' machines.

        Shrinking leaves margins too near to 0.  A logistic curve tells how fast scores rise, and the cut is the one with the
        fewest errors, a false alarm counting ``false_cost`` times a miss.
        """
        order = np.argsort(margins, kind="stable")
        m, t = margins[order], y[order]
        # cost of marking everything from place k on
        cost = np.concatenate(([0], np.cumsum(t))) + false_cost * ((1 - t).sum() - np.concatenate(([0], np.cumsum(1 - t))))
        gap = np.diff(m, prepend=m[0] - 1, append=m[-1] + 1)
        k = min(range(len(cost)), key=lambda j: (cost[j], -gap[j]))
        cut = (m[k - 1] if k else m[0] - 1) + 0.75 * gap[k]
        self.slope = max(_curve(m, t)[0], 1.0)
        self.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - self.slope * cut)
        return self

    def places(self, found: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.buckets, found)
        return k[self.buckets[np.minimum(k, len(self.buckets) - 1)] == found] if len(self.buckets) else k[:0]

    def scorer(self) -> Callable[[str | None], float]:
        index = {int(b): k for k, b in enumerate(self.buckets)}
        memo: dict[str, int] = {}
        def number(term: str) -> int:
            k = memo.get(term)
            if k is None:
                if len(memo) > 2_000_000:
                    memo.clear()
                k = memo[term] = index.get(_bucket(term), -1)
            return k

        def score(text: str | None) -> float:
            at = {number(t) for t in toxicity_terms(text)}
            at.discard(-1)
            return float(_sigmoid(np.array(self.slope * self.margin(np.array(sorted(at), dtype=np.int64)) + self.shift)))

        return score


class NaiveBayesSVM:
    """Hinge loss over n-gram indicators scaled by log-count ratios."""

    def __init__(self, x: tuple[np.ndarray, np.ndarray], y: np.ndarray, c: float = 0.1, epochs: int = 15, seed: int = 1, smoothing: float = 1.0):
        self.buckets, flat, offsets = _frequent(x, LEAST_DOCUMENTS)
        n, rng = len(self.buckets), np.random.default_rng(seed)
        share = (y.sum() + 1) / (len(y) + 2)
        self.w, self.bias, self.slope, self.shift = np.zeros(n), 0.0, 1.0, float(np.log(share / (1 - share)))
        if not n or len(np.unique(y)) < 2:
            return
        row = np.repeat(np.arange(len(y)), np.diff(offsets))
        p = smoothing + np.bincount(flat, weights=y[row], minlength=n)
        q = smoothing + np.bincount(flat, weights=1 - y[row], minlength=n)
        ratio = np.log((p / p.sum()) / (q / q.sum()))
        value, sign = ratio[flat], np.where(y > 0, 1.0, -1.0)
        # a document's indicators are scaled to unit length, so that long ones don't outweigh short ones
        norm = np.sqrt(np.maximum(np.bincount(row, weights=value**2, minlength=len(y)), 1e-12))
        value = value / norm[row]
        self.ratio = ratio
        held = rng.random(len(y)) < 0.2  # for the logistic curve
        fit = np.flatnonzero(~held)
        # both classes weigh the same
        cost = np.where(y > 0, c * len(y) / (2 * max(y.sum(), 1)), c * len(y) / (2 * max((1 - y).sum(), 1))) * 10
        alpha, w, b = np.zeros(len(y)), np.zeros(n), 0.0
        for _ in range(epochs):
            for i in rng.permutation(fit):
                a, e = offsets[i], offsets[i + 1]
                k, u = flat[a:e], value[a:e]
                gradient = sign[i] * (w[k] @ u + b) - 1
                new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])  # |x|^2 + 1 for the bias
                if new != alpha[i]:
                    step = (new - alpha[i]) * sign[i]
                    w[k] += step * u
                    b += step
                    alpha[i] = new
        self.w, self.bias = w, b
        margin = np.bincount(row, weights=w[flat] * value, minlength=len(y)) + b
        m, t = margin[held], y[held]
        if len(np.unique(t)) < 2:
            m, t = margin, y
        self.slope, self.shift = _curve(m, t)

    def scorer(self) -> Callable[[str | None], float]:
        buckets, w, ratio = self.buckets, self.w, getattr(self, "ratio", np.zeros(len(self.buckets)))
        bias, slope, shift = self.bias, self.slope, self.shift

        def score(text: str | None) -> float:
            found = quality_buckets(text)
            k = np.searchsorted(buckets, found)
            k = k[buckets[np.minimum(k, len(buckets) - 1)] == found] if len(buckets) else k[:0]
            r = ratio[k]
            margin = (w[k] @ r) / max(float(np.sqrt(r @ r)), 1e-6) + bias if len(k) else bias
            return float(_sigmoid(np.array(slope * margin + shift)))

        return score


def score_column(model: FactorizationMachine | NaiveBayesSVM, text: Column, spark: SparkSession) -> Column:
    """Score (0 to 1) of each text."""
    shared = spark.sparkContext.broadcast(model)  # bounded by max_rows

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value.scorer()
        try:
            for s in batches:
                yield pd.Series([one(t if isinstance(t, str) else None) for t in s], dtype=float)
        finally:
            forget()

    return score(text)


def held_margins(spark: SparkSession, x: tuple[np.ndarray, np.ndarray], y: np.ndarray, settings: tuple[dict, ...], folds: int = FOLDS) -> np.ndarray | None:
    """For each of the settings the margin of every row by a machine fitted to the other folds, each fit a task; None where a fold leaves one class only."""
    (flat, offsets), fold = x, np.random.default_rng(0).integers(0, folds, len(y))
    if any(len(np.unique(y[fold != f])) < 2 for f in range(folds)):
        return None
    shared = spark.sparkContext.broadcast((flat, offsets, y, fold))  # bounded by max_rows

    def fit(tasks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat, offsets, y, fold = shared.value
        lengths = np.diff(offsets)
        for k in (int(i) for t in tasks for i in t["id"]):
            held = fold == k % folds
            machine = FactorizationMachine((flat[np.repeat(~held, lengths)], np.concatenate(([0], np.cumsum(lengths[~held])))), y[~held], **settings[k // folds])
            rows = np.flatnonzero(held)
            yield pd.DataFrame({"setting": k // folds, "row": rows, "margin": [machine.margin(machine.places(flat[offsets[r] : offsets[r + 1]])) for r in rows]})

    n = folds * len(settings)
    got, out = spark.range(0, n, 1, n).mapInPandas(fit, "setting int, row long, margin double").toPandas(), np.zeros((len(settings), len(y)))
    shared.unpersist()
    out[got["setting"], got["row"]] = got["margin"]
    return out


def _loss(m: np.ndarray, t: np.ndarray) -> float:
    slope, shift = _curve(m, t)
    return float(-np.log(np.maximum(_sigmoid((slope * m + shift) * (2 * t - 1)), 1e-9)).mean())


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS) -> FactorizationMachine:
    """How strongly vectors are held back is chosen among ``STRENGTHS`` by cross-validation."""
    x, y = training_rows(docs, labels, "toxic", learn, toxicity_buckets, max_rows)
    margins = held_margins(docs.sparkSession, x, y, STRENGTHS)
    if margins is None:
        return FactorizationMachine(x, y)
    best = min(range(len(STRENGTHS)), key=lambda k: _loss(margins[k], y))
    return FactorizationMachine(x, y, **STRENGTHS[best]).placed(margins[best], y)


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS) -> NaiveBayesSVM:
    return NaiveBayesSVM(*training_rows(docs, labels, "quality", learn, quality_buckets, max_rows))


def _scored(docs: DataFrame, model: FactorizationMachine | NaiveBayesSVM, held_out: Column) -> DataFrame:
    out = docs.select("doc_id", held_out.alias("held_out"), score_column(model, F.col("text"), docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, remainder(F.col("_id"), 3) != 1)
    return _scored(docs, model, remainder(F.col("doc_id"), 3) == 1)


def op8_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, remainder(F.col("_id"), 4) != 2)
    return _scored(docs, model, remainder(F.col("doc_id"), 4) == 2)
