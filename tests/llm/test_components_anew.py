"""Components after further links equal those of all links, and only components that these join are labelled anew."""

import random

from tallyweir.llm import setjoin


def _frame(spark, links):
    return spark.createDataFrame(links, "_x long, _y long")


def _labels(df):
    got = [(r._id, r._label) for r in df.collect()]
    assert len(got) == len(set(got))
    return dict(got)


def test_further_links_join_components(spark):
    rng = random.Random(3)
    links = [tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)]
    first, rest = links[:25], [*links[25:], (2, 70), (70, 71), (80, 81)]
    whole = _labels(setjoin.connected(_frame(spark, first + rest)))
    assert _labels(setjoin.relabelled(setjoin.connected(_frame(spark, first)), _frame(spark, rest))) == whole


def test_links_inside_components_are_not_labelled_anew(spark, monkeypatch):
    labels = setjoin.connected(_frame(spark, [(k, k + 1) for k in range(9)] + [(20, 21)]))
    before, asked = _labels(labels), []
    monkeypatch.setattr(setjoin, "connected", lambda edges, of=setjoin.connected: asked.append(edges.count()) or of(edges))
    assert _labels(setjoin.relabelled(labels, _frame(spark, [(0, 5), (3, 9), (20, 21)]))) == before and asked == [0]
    joined = _labels(setjoin.relabelled(labels, _frame(spark, [(4, 21), (7, 20)])))
    assert asked == [0, 1] and joined == before | {20: 0, 21: 0}
