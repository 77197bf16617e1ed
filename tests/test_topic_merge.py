"""Merging like topics: no similar pair is missed, and the edges of the input."""

import random

import numpy as np
import pytest

from topictide.operators import topic_merge as M


@pytest.mark.parametrize("similarity", [0.5, 0.85, 0.99])
def test_similar_topics_equal_all_pairs(spark, similarity):
    r = random.Random(4)
    base = [{f"t{r.randrange(40)}": r.random() for _ in range(8)} for _ in range(6)]
    vectors = []
    for i in range(40):
        v = dict(base[i % 6])
        for _ in range(r.randint(0, 3)):
            v[f"t{r.randrange(40)}"] = r.random() * 0.6
        size = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / size for t, x in v.items()})
    df = spark.createDataFrame([(i, t, x) for i, v in enumerate(vectors) for t, x in v.items()], "cluster int, term string, weight double")
    dot = lambda a, b: sum(x * vectors[b].get(t, 0.0) for t, x in vectors[a].items())
    want = {(a, b): dot(a, b) for a in range(40) for b in range(a + 1, 40) if dot(a, b) >= similarity}
    got = {(x.a, x.b): x.similarity for x in M.similar_topics(df, similarity).collect()}
    assert set(got) == set(want) and (similarity == 0.99 or len(want) > 20)
    assert all(got[p] == pytest.approx(want[p]) for p in want)
    topic = {x.cluster: x.topic for x in M.merged_topics(df, similarity).collect()}
    assert len(topic) == 40 and all(topic[a] == topic[b] for a, b in want) and all(topic[topic[c]] == topic[c] <= c for c in topic)


def test_terms_and_representatives(spark):
    rows = [(1, 0, "apple apple pear"), (2, 0, "apple plum"), (3, 0, None), (4, 1, "stone iron iron"), (5, 1, "iron"), (6, -1, "noise noise"), (7, 2, "")]
    posts = spark.createDataFrame(rows, "row_id long, cluster int, text string")
    weights = M.class_weights(M.topic_term_counts(posts))
    size = {r.cluster: r.s for r in weights.groupBy("cluster").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "s").collect()}
    assert set(size) == {0, 1}  # noise and topics without words have none
    top = {(r.cluster, r.position): r.term for r in M.top_terms(weights, 2, ["stone"]).collect()}
    assert top == {(0, 1): "apple", (0, 2): "pear", (1, 1): "iron"}
    best = [(r.cluster, r.position, r.row_id) for r in M.representative_posts(posts, weights, 2).orderBy("cluster", "position").collect()]
    assert best == [(0, 1, 1), (0, 2, 2), (1, 1, 4), (1, 2, 5)] or best[:2] == [(0, 1, 1), (0, 2, 2)]
    assert M.merged_topics(weights).where("topic = cluster").count() == 2


def test_empty(spark):
    none = spark.createDataFrame([], "row_id long, cluster int, text string")
    weights = M.class_weights(M.topic_term_counts(none))
    assert weights.count() == 0 and M.merged_topics(weights).count() == 0 and M.representative_posts(none, weights).count() == 0
    assert np.isfinite(M.MERGE_SIMILARITY)
