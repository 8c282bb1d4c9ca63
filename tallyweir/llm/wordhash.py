"""Hashes of words and of runs of words, vectorised over many documents at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words hashed at a time; a longer document is one piece of its own.
FLUSH_WORDS = 250_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class WordHasher:
    """64-bit hashes of words, remembered while the vocabulary stays small."""

    def __init__(self, lower: bool = False):
        self.memo, self.lower = _Memo(), lower

    def split(self, text: str | None) -> list[bytes]:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        return (raw.lower() if self.lower else raw).split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > 250_000:
            self.memo.clear()
        return np.fromiter(map(self.memo.__getitem__, words), dtype=np.uint64, count=len(words))


def pieces(batches: Iterator[pa.RecordBatch], hasher: WordHasher, text: str = "_text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, word hashes of all their texts, first word of each row and the end)."""
    for batch in batches:
        texts, start, words, ends = batch.column(text), 0, [], [0]
        for k in range(len(texts)):
            words += hasher.split(texts[k].as_py())
            ends.append(len(words))
            if len(words) >= FLUSH_WORDS or k == len(texts) - 1:
                yield batch.slice(start, k + 1 - start), hasher.hashes(words), np.array(ends)
                start, words, ends = k + 1, [], [0]


def run_hashes(h: np.ndarray, k: int, multiplier: np.uint64 = _M1) -> np.ndarray:
    """Hash of the k words from each place on; the last k-1 places have none."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out, have, power, acc, acc_len = None, 1, multiplier, h * np.uint64(0xBF58476D1CE4E5B9) ^ (h >> np.uint64(29)), 0
        done = None
        while True:
            if k & have:
                n = len(h) - (acc_len + have) + 1
                done = acc[:n].copy() if done is None else done[:n] * power + acc[acc_len : acc_len + n]
                acc_len += have
            if acc_len == k:
                break
            n = len(acc) - have
            acc = acc[:n] * power + acc[have : have + n]
            power, have = power * power, have * 2
        out = done
        return (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def second_run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """An independent second hash of the same runs."""
    with np.errstate(over="ignore"):
        return run_hashes((h ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xDA942042E4DD58B5), k, _M2)


def run_documents(ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places whose k words lie in one document, that document)."""
    lengths = np.diff(ends)
    counts = np.maximum(lengths - k + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return ends[:-1][doc] + inside, doc


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least of the w values from each place on."""
    have, out = 1, a
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def table_map(fn: Callable) -> Callable:
    """For mapInArrow: ``fn`` gets the batches and yields dicts of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_pydict(columns)

    return run
