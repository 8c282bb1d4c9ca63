"""Line chunks of texts whose paragraphs are set apart by blank lines."""

import hashlib
import random

from tallyweir.llm import linechunks


def brute_force(rows: list[tuple]) -> dict:
    """doc_id to (lines, lines removed, text kept)."""
    chunks, seen = [], set()
    for d, text in sorted(rows):
        before, was, start = 0, False, 0
        lines = text.split("\n")
        for i, line in enumerate(lines):
            h = int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
            end = (h + before * linechunks._BASE) % linechunks._MODULUS % linechunks.DIVISOR == 0
            if (end and not was) or i == len(lines) - 1:
                chunks.append((d, lines[start : i + 1]))
                start = i + 1
            before, was = h, end
    out = {d: [0, 0, []] for d, _ in rows}
    for d, part in chunks:
        lost = len(part) >= 2 and any(x.strip(" \t\n\x0b\x0c\r") for x in part) and tuple(part) in seen
        seen.add(tuple(part))
        out[d][0] += len(part)
        out[d][1] += len(part) * lost
        out[d][2] += [] if lost else part
    return {d: (n, gone, "\n".join(kept)) for d, (n, gone, kept) in out.items()}


def test_paragraphs_between_blank_lines(spark):
    rng = random.Random(2)
    shared = [" ".join(f"s{k}w{j}" for j in range(60)) for k in range(20)]
    rows = []
    for d in range(12):
        own = [" ".join(f"d{d}p{k}w{j}" for j in range(8)) for k in range(3)]
        rows.append((d, rng.choice(["\n\n", "\n \n", "\n\n\n"]).join([own[0], *shared, *own[1:]])))
    rows += [(90, "\n\n\n\n"), (91, "\n\n\n\n"), (92, "one\n")]
    out = {r.doc_id: (r._n_lines, r._n_removed, r.text) for r in linechunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == brute_force(rows)
    assert sum(n for _, n, _ in out.values()) > 200 and out[91][1] == 0  # blank lines alone are never removed
