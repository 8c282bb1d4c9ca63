"""Count-min sketches filled by many tasks, merged block by block.

A task sends its part of a sketch as sorted cell numbers with counts; parts are
summed per block of cells.  ``sketch`` keeps one bit a cell, whether a count is
reached; ``frequencies`` keeps the count's magnitude in four bits.  Both hold at
most ``MAX_BITS`` bits (256 MB, what a worker holds).  Estimates are never too
low.  Beyond that bound more entries pass or look frequent; whoever asks checks
exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from tallyweir.llm.common import written

_ROWS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
DEPTH, CELLS_PER_ENTRY, BLOCK, MAX_BITS = 2, 4, 1 << 20, 1 << 31


def bits_for(entries: float) -> int:
    """log2 of the number of cells for so many entries."""
    return int(np.clip(np.ceil(np.log2(max(entries, 1) * CELLS_PER_ENTRY * DEPTH)), 16, np.log2(MAX_BITS)))


def _cells(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    width = np.uint64((1 << bits) // DEPTH)
    for row, multiplier in enumerate(_ROWS[:DEPTH]):
        with np.errstate(over="ignore"):
            yield ((hashes * multiplier) >> np.uint64(24)) % width + width * np.uint64(row)


def _packed(values: np.ndarray) -> bytes:
    """The lowest bytes of all 32-bit values, then the second ones and so on: mostly zeros, which the shuffle's codec shortens."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


def _parts(entries: Callable, cells_of: Callable) -> Callable:
    def part(held: list) -> Iterator[pa.RecordBatch]:
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        block, at = cells // BLOCK, (cells % BLOCK).astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield pa.RecordBatch.from_pydict({"block": pa.array([int(block[a])], pa.int32()), "at": pa.array([_packed(np.diff(at[a:b], prepend=0))]), "n": pa.array([_packed(counts[a:b])])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for hashes in entries(batches):
            if len(hashes):
                held += (new := list(cells_of(hashes)))
                size += sum(map(len, new))
            if size > 1_500_000:
                yield from part(held)
                held, size = [], 0
        if size:
            yield from part(held)

    return run


def _merge(packed: Callable) -> Callable:
    def merge(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BLOCK, dtype=np.int64)
        for batch in groups:
            for at, n in zip(batch.column("at"), batch.column("n"), strict=True):
                count[np.cumsum(_unpacked(at.as_py()).astype(np.int64))] += _unpacked(n.as_py())
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([packed(count)])})

    return merge


def _gathered(rows: DataFrame, entries: Callable, cells_of: Callable, packed: Callable, cells: int, bits_a_cell: int) -> Broadcast:
    """All merged blocks in one array of MAX_BITS / 8 bytes at most, gathered block by block and sent to every task."""
    parts = rows.mapInArrow(_parts(entries, cells_of), "block int, at binary, n binary")
    merged = written(parts.groupBy("block").applyInArrow(_merge(packed), "block int, bits binary"), "sketch")
    size = BLOCK * bits_a_cell // 8
    flat = bytearray(max(cells // BLOCK, 1) * size)
    for row in merged.toLocalIterator():
        flat[row["block"] * size : (row["block"] + 1) * size] = row["bits"]
    return rows.sparkSession.sparkContext.broadcast(flat)


class _Sketch:
    """Cells that tasks read in place; ``close`` frees them everywhere once nothing reads them any more."""

    def __init__(self, bits: int, flat: Broadcast):
        self.bits, self.flat = bits, flat

    def close(self) -> None:
        self.flat.destroy()


class Bitmap(_Sketch):
    """Entries whose estimated count reaches the sketch's threshold."""

    def __contains__(self, _: object) -> bool:
        raise TypeError("use hits()")

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        flat = np.frombuffer(self.flat.value, dtype=np.uint8)
        hit = np.ones(len(hashes), dtype=bool)
        for cells in _cells(hashes, self.bits):
            hit &= (flat[cells >> np.uint64(3)] >> (np.uint64(7) - (cells & np.uint64(7))).astype(np.uint8)) & 1 > 0
        return hit


def sketch(rows: DataFrame, entries: Callable, expected: float, least: int = 2) -> Bitmap:
    """Bitmap of the hashes that ``entries(batches)`` yields ``least`` (1 or 2) times or more over all ``rows``."""
    bits = bits_for(expected)
    return Bitmap(bits, _gathered(rows, entries, lambda h: _cells(h, bits), lambda count: np.packbits(count >= least).tobytes(), 1 << bits, 1))


def _cell(hashes: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (hashes * _ROWS[0]) >> np.uint64(64 - bits)


def _magnitudes(count: np.ndarray) -> bytes:
    size = np.minimum(np.log2(np.maximum(count, 1)), 15).astype(np.uint8)
    return (size[0::2] | size[1::2] << 4).tobytes()


class Frequencies(_Sketch):
    """log2 (0 to 15) of estimated counts, four bits a cell."""

    def of(self, hashes: np.ndarray) -> np.ndarray:
        flat, cell = np.frombuffer(self.flat.value, dtype=np.uint8), _cell(hashes, self.bits)
        return (flat[cell >> np.uint64(1)] >> ((cell & np.uint64(1)) << np.uint64(2)).astype(np.uint8)) & 15


def frequencies(rows: DataFrame, entries: Callable, expected: float) -> Frequencies:
    """Magnitudes of the counts of all hashes that ``entries(batches)`` yields; about a cell for two of ``expected`` entries, up to MAX_BITS."""
    bits = int(np.clip(np.round(np.log2(max(expected, 1) / 2)), 16, np.log2(MAX_BITS // 4)))
    return Frequencies(bits, _gathered(rows, entries, lambda h: [_cell(h, bits)], _magnitudes, 1 << bits, 4))
