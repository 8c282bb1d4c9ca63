"""Quality rules: counts of a text, and its divergence from its language.

For every language the corpus holds, two reference histograms are taken over all
documents: characters by class, and common words (a share of ``COMMON`` or more)
with all others as one bin.  Tasks report the count of every word, and only the
sums over all documents are compared with ``COMMON``, so that references depend
neither on the order of the rows nor on their partitions.  A document is compared with the references of its
``lang``, or with the nearest of all references where ``lang`` is null or has none
(every language with a word has one, whatever its share of the corpus; should a dirty column
name more than ``MOST_LANGUAGES``, which is about as many as are written, those with the most words have one), by the Jensen-Shannon distance (base 2, 0 to 1).  Short texts stray from any
reference by chance, hence each distance is only used from a least length on and
its limit is widened by a term that falls with the square root of the length.

Null and empty texts have counts of 0 and fail the base rule; the distances of
texts under the least lengths are null and don't count against them.  Repeated
rows are judged each.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.llm.common import table, written

CLASSES = ("lower", "upper", "letter beyond ASCII", "digit", "white space", "punctuation", "symbol", "other")
COMMON, MOST_LANGUAGES = 0.002, 4_096
#: Least lengths, limits, and the widening for a text of one character or word.
LEAST_CHARS, CHAR_LIMIT, CHAR_WIDEN = 100, 0.2, 1.0
LEAST_WORDS, WORD_LIMIT, WORD_WIDEN = 40, 0.3, 1.0


def _class_of(code: int) -> int:
    c = chr(code)
    if code < 128:
        if c.islower():
            return 0
        if c.isupper():
            return 1
        if c.isdigit():
            return 3
        if c in " \t\n\x0b\x0c\r":
            return 4
        return 5 if c in ".,;:!?'\"()-" else 6 if code > 32 else 7
    return 2 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in "‘’“”–—…¿¡«»" else 7


#: Classes of the code points in most texts; others are looked up one by one.
_TABLE = np.array([_class_of(k) for k in range(0x3000)], dtype=np.uint8)
_far_class = lru_cache(maxsize=1 << 16)(_class_of)
_SPACE = np.zeros(128, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(128, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def class_counts(codes: np.ndarray) -> np.ndarray:
    near = codes < len(_TABLE)
    if near.all():
        return np.bincount(_TABLE[codes], minlength=len(CLASSES))
    far, n = np.unique(codes[~near], return_counts=True)
    return class_counts(codes[near]) + np.bincount([_far_class(int(c)) for c in far], weights=n, minlength=len(CLASSES)).astype(np.int64)


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """Words inside k-word windows that the text holds twice or more."""
    windows = list(zip(*(words[j:] for j in range(k)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    n = Counter(windows)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.array([j for j, w in enumerate(windows) if n[w] > 1])
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _reference_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str | None, Counter] = {}
    classes: dict[str | None, np.ndarray] = {}
    n = 0

    def report() -> Iterator[pa.RecordBatch]:
        for lang, count in words.items():
            total = sum(count.values())
            rows = [("w", w.decode("utf-8", "replace"), c) for w, c in count.items()]
            rows += [("n", "", total), *(("c", str(k), int(c)) for k, c in enumerate(classes[lang]))]
            for s in range(0, len(rows), 50_000):
                kinds, keys, counts = zip(*rows[s : s + 50_000], strict=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(kinds), pa.string()), "kind": pa.array(kinds), "key": pa.array(keys), "n": pa.array(counts, pa.int64())})

    for batch in batches:
        for text, lang in zip(batch.column("_text"), batch.column("_lang"), strict=True):
            text, lang = text.as_py(), lang.as_py()
            if not text or lang is None:
                continue
            got = text.encode("utf-8", "surrogatepass").lower().split()
            words.setdefault(lang, Counter()).update(got)
            classes[lang] = classes.get(lang, 0) + class_counts(_codes(text))
            n += len(got)
            if n >= 1_000_000:
                yield from report()
                words, classes, n = {}, {}, 0
    yield from report()


def language_references(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, tuple[dict[bytes, int], np.ndarray, np.ndarray]]:
    """Per language: number of each common word, word shares (others last), class shares."""
    rows = docs.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    parts = rows.mapInArrow(_reference_parts, "lang string, kind string, key string, n long")
    sums = written(parts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "word-counts")  # read twice
    total = sums.where("kind = 'n'").select("lang", F.col("n").alias("total"))
    total = total.where("total > 0").orderBy(F.desc("total"), "lang").limit(MOST_LANGUAGES)
    # at most 1 / COMMON words and len(CLASSES) + 1 other rows of each language
    sums = sums.join(total, "lang").where((F.col("kind") != "w") | (F.col("n") >= F.col("total") * COMMON))
    found: dict[str, dict] = {}
    for row in sums.orderBy("lang", "kind", F.col("n").desc(), "key").collect():
        found.setdefault(row["lang"], {"w": [], "c": {}, "n": 0})
        at = found[row["lang"]]
        if row["kind"] == "w":
            at["w"].append((row["key"].encode("utf-8"), row["n"]))
        elif row["kind"] == "c":
            at["c"][int(row["key"])] = row["n"]
        else:
            at["n"] = row["n"]
    out = {}
    for name, at in found.items():
        shares = np.array([n for _, n in at["w"]], dtype=float) / max(at["n"], 1)
        classes = np.array([at["c"].get(k, 0) for k in range(len(CLASSES))], dtype=float)
        out[name] = ({w: k for k, (w, _) in enumerate(at["w"])}, np.append(shares, max(0.0, 1 - shares.sum())), classes / max(classes.sum(), 1))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two distributions."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, (left + right) / 2)))


def distances(words: list[bytes], classes: np.ndarray, reference: tuple) -> tuple[float, float]:
    """(characters, words) distance from one language."""
    index, word_shares, class_shares = reference
    n = Counter(map(index.get, words))
    got = np.array([n.get(k, 0) for k in range(len(index))] + [n.get(None, 0)], dtype=float)
    return js_distance(classes / max(classes.sum(), 1), class_shares), js_distance(got / max(got.sum(), 1), word_shares)


RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField("char_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType())]
)


def judge(text: str | None, lang: str | None, references: dict) -> tuple:
    """One row of ``RESULT``."""
    text = text or ""
    codes = _codes(text)
    words = text.encode("utf-8", "surrogatepass").split()
    low = np.minimum(codes, 127)
    n, repeats = len(words), repeated_words(words)
    failed = base_fails(n, repeats)
    char_d = word_d = None
    near = [references[lang]] if lang in references else list(references.values())
    if near and len(codes) >= LEAST_CHARS:
        classes, lowered = class_counts(codes), [w.lower() for w in words]
        char_d, word_d = min((distances(lowered, classes, r) for r in near), key=sum)
        word_d = word_d if n >= LEAST_WORDS else None
    strays = (char_d is not None and char_d > CHAR_LIMIT + CHAR_WIDEN / len(codes) ** 0.5) or (word_d is not None and word_d > WORD_LIMIT + WORD_WIDEN / n**0.5)
    counts = (n, int(len(codes) - _SPACE[low].sum()), int((_SYMBOL[low] & (codes < 128)).sum()), repeated_lines(text), repeats)
    return (*counts, failed, not failed and not strays, char_d, word_d)


def apply_quality_rules(docs: DataFrame, references: dict, text: str = "text", lang: str = "lang", out: str = "rules") -> DataFrame:
    """``docs`` with a struct ``out`` of ``RESULT`` (replaced if there is a column of that name)."""
    shared = docs.sparkSession.sparkContext.broadcast(references)

    @F.pandas_udf(RESULT)
    def rules(texts, langs):
        import pandas as pd

        rows = [judge(t if isinstance(t, str) else None, x if isinstance(x, str) else None, shared.value) for t, x in zip(texts, langs, strict=True)]
        return pd.DataFrame(rows, columns=RESULT.names)

    return docs.withColumn(out, rules(F.col(text), F.col(lang)))


def op4_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = apply_quality_rules(docs, language_references(docs))
    return judged.select("doc_id", *(F.col("rules")[c].alias(c) for c in RESULT.names))
