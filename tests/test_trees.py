"""Histogram trees: what a split is worth, the two ways of growing, leaf limits, and fits of folds."""

import heapq
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from topictide.operators import fitting
from topictide.operators import trees as T


def data(n=600, f=5, seed=1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(0, 1, (n, f)), 2)
    s = np.column_stack([x[:, 0] + x[:, 1] ** 2, np.full(n, 0.7), x[:, 2] - x[:, 0]])
    return np.arange(n) * 7 - 100, x, (s + r.gumbel(0, 0.4, s.shape)).argmax(1), r.uniform(0.5, 2, n)


@pytest.mark.parametrize("params", [T.Params("boosting", 1, 1, 10, features=0), T.Params("forest", 1, 1, 8, features=0)])
def test_first_split_is_the_best_of_all(params):
    ids, x, y, w = data(200)
    edges = [T.bin_edges(x[:, f]) for f in range(x.shape[1])]
    stats = (T.gradients(np.tile(T.start_scores(params, np.bincount(y, w)), (len(y), 1)), y, w, 0) if params.kind == "boosting"
             else T.forest_stats(params, ids, y, w, 0))

    def worth(s):
        return s[0] ** 2 / (s[1] + params.l2) if params.kind == "boosting" else (s[:-1] ** 2).sum() / max(s[:-1].sum(), 1e-9)

    best = max(((worth(stats[m].sum(0)) + worth(stats[~m].sum(0)) - worth(stats.sum(0)), -f, -k)
                for f in range(x.shape[1]) for k, c in enumerate(edges[f]) for m in [x[:, f] <= c]
                if min(stats[m, -1].sum(), stats[~m, -1].sum()) >= params.min_leaf))
    tree = T.fit_in_task(params, ids, x, y, w)
    assert tree.gain[0, 0] == pytest.approx(best[0]) and tree.feature[0, 0] == -best[1]
    assert tree.cut[0, 0] == pytest.approx(edges[-best[1]][-best[2]])


def test_boosting_lowers_the_loss_and_forest_predicts():
    ids, x, y, w = data(1200)
    loss = []
    for rounds in (1, 10, 60):
        p = T.fit_in_task(replace(T.BOOSTING, trees=rounds), ids, x, y, np.ones(len(y))).probabilities(x)
        assert np.allclose(p.sum(axis=1), 1)
        loss.append(-np.log(p[np.arange(len(y)), y]).mean())
    assert loss[0] > loss[1] > loss[2]
    held = T.fit_in_task(replace(T.FOREST, trees=40), ids[:800], x[:800], y[:800], np.ones(800)).probabilities(x[800:])
    assert (held.argmax(1) == y[800:]).mean() > 0.6 and held.min() >= 0 and np.allclose(held.sum(axis=1), 1)


def test_leaves_are_limited_by_a_queue_of_gains():
    ids, x, y, w = data(1500)
    free = T.fit_in_task(replace(T.FOREST, trees=3, leaves=0), ids, x, y, w)
    for limit in (2, 9, 40):
        some = T.fit_in_task(replace(T.FOREST, trees=3, leaves=limit), ids, x, y, w)
        for t in range(3):
            inner = some.feature[t] >= 0
            assert inner.sum() + 1 == limit  # a binary tree has one leaf more than splits
            want, queue = [], [(-free.gain[t, 0], 0)]
            while len(want) < limit - 1:
                gain, node = heapq.heappop(queue)
                want.append(-gain)
                queue += [(-free.gain[t, c], c) for c in (free.left[t, node], free.right[t, node]) if free.feature[t, c] >= 0]
                heapq.heapify(queue)
            np.testing.assert_allclose(sorted(some.gain[t, inner]), sorted(want))


@pytest.mark.parametrize("params", [replace(T.BOOSTING, trees=3), replace(T.FOREST, trees=20, depth=4, leaves=7)])
def test_blocks_grow_the_same_trees_as_a_task(spark, monkeypatch, params):
    monkeypatch.setattr(T, "BLOCK_ROWS", 90)
    fits, rows, edges = {0: data(500), 3: data(300, seed=4)}, [], {}
    for fit, (ids, x, y, w) in fits.items():
        edges[fit] = [T.bin_edges(x[:, f]) for f in range(x.shape[1])]
        rows += [(fit, int(i), v.tolist(), int(c), float(u)) for i, v, c, u in zip(ids, x, y, w)]
    df = spark.createDataFrame(rows, "fit long, id long, x array<double>, y long, w double").repartition(6)
    got = T.fit_in_blocks(params, df, 5, edges)
    for fit, (ids, x, y, w) in fits.items():
        want = T.fit_in_task(params, ids, x, y, w, edges[fit])
        np.testing.assert_array_equal(got[fit].feature, want.feature)
        np.testing.assert_allclose(got[fit].cut, want.cut)
        np.testing.assert_allclose(got[fit].value, want.value, atol=1e-9)
    side_by_side = T.fit(params, df, 5)  # in tasks
    np.testing.assert_array_equal(side_by_side[3].feature, T.fit_in_task(params, *fits[3]).feature)
    approximate = T.fit(params, df, 5, task_rows=10)  # in blocks, with its own cuts
    assert approximate[0].probabilities(fits[0][1]).shape == (500, 3)


def test_table_round_trip(spark):
    ids, x, y, w = data(300)
    for params in (replace(T.BOOSTING, trees=2), replace(T.FOREST, trees=4)):
        f = T.fit_in_task(params, ids, x, y, w)
        again = T.from_table(T.table(f, spark), params, f.start.tolist())
        np.testing.assert_allclose(again.probabilities(x), f.probabilities(x))
        np.testing.assert_allclose(again.importances(5), f.importances(5))


def test_bootstrap_counts_are_poisson():
    n = T.drawn(np.arange(100_000), 3, 42)
    assert n.mean() == pytest.approx(1, abs=0.02) and n.var() == pytest.approx(1, abs=0.03) and n.max() < 9


def test_logistic_and_sigmoid_reach_their_optimum(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    ids, x, y, w = data(400, 3)
    p = fitting.logistic(x, y, w, 1.0)(x)
    df = spark.createDataFrame([(*map(float, v), float(c), float(u)) for v, c, u in zip(x, y, w)], "a double, b double, c double, label double, weight double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(df)
    df = StandardScaler(inputCol="v", outputCol="features", withMean=True).fit(df).transform(df)
    lr = LogisticRegression(family="multinomial", weightCol="weight", regParam=1.0 / w.sum(), standardization=False, maxIter=300, tol=1e-10).fit(df)
    want = np.array([r.probability.toArray() for r in lr.transform(df).collect()])
    np.testing.assert_allclose(p, want, atol=1e-4)
    r = np.random.default_rng(0)
    z = r.normal(0, 2, 5000)
    a, b = fitting.sigmoid(z, (r.random(5000) < 1 / (1 + np.exp(-(0.7 * z - 0.4)))).astype(float))
    assert a == pytest.approx(0.7, abs=0.06) and b == pytest.approx(-0.4, abs=0.08)


def test_class_never_seen_and_constant_columns():
    ids, x, y, _ = data(200, 3)
    x[:, 1] = 5.0
    y = np.where(y == 1, 0, y)
    for params in (None, replace(T.BOOSTING, trees=3), replace(T.FOREST, trees=5)):
        p = fitting.fold_scores(params, ids, x, y, x, True)
        assert (p[:, 1] == 0).all() and np.allclose(p.sum(axis=1), 1) and np.isfinite(p).all()


def test_sigmoids_agree_between_task_and_aggregates(spark):
    from topictide.plans import training

    r = np.random.default_rng(5)
    p = r.dirichlet([1, 1, 1], 500)
    rows = [(training.DIRECTIONS[r.choice(3, p=q / q.sum())], *map(float, q)) for q in p ** 0.7]
    df = spark.createDataFrame(rows, "target string, p_down double, p_flat double, p_up double").withColumn("p_up", F.col("p_up"))
    one, other = training.sigmoids_in_task(df), training.sigmoids(df)
    np.testing.assert_allclose(one, other, atol=1e-5)
