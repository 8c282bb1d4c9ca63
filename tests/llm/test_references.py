"""Reference histograms against counts of all words."""

from collections import Counter

import numpy as np

from tallyweir.llm import divergence


def _expected(rows: list[tuple]) -> dict:
    out = {}
    for lang in {x for _, x, t in rows if x is not None and t}:
        texts = [t for _, x, t in rows if x == lang and t]
        n, classes = Counter(w for t in texts for w in t.lower().encode().split()), sum(divergence.class_counts(divergence._codes(t)) for t in texts)
        total = n.total()
        common = {w: c / total for w, c in n.items() if c >= total * divergence.COMMON}
        out[lang] = (common, 1 - sum(common.values()), classes / classes.sum())
    return out


def test_references_count_every_word_in_every_partition(spark):
    # "hot" has 4 of the first part's 10,000 words and 38 of the second's: 0.0021 of all
    fill = lambda n: [f"f{k}" for k in range(n)]
    first, second = ["hot"] * 4 + fill(9996), ["Hot"] * 38 + fill(9962)
    rows = [(1, "en", " ".join(first)), (2, "de", "eins zwei zwei"), (3, None, "none"), (5, "en", " ".join(second)), (6, "de", "drei Zwei é"), (7, "en", None), (8, "fr", "")]
    parts = lambda n: spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "doc_id long, lang string, text string")
    everything = _expected(rows)
    assert everything["en"][0] == {b"hot": 42 / 20000}
    for docs in (parts(2), parts(1)):
        found = divergence.language_references(docs)
        assert set(found) == set(everything)
        for lang, (index, words, classes) in found.items():
            common, others, shares = everything[lang]
            assert {w: words[k] for w, k in index.items()} == common
            assert abs(words[-1] - others) < 1e-12 and np.allclose(classes, shares)
