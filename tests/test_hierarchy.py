"""The metric index and the hierarchy of density clusters against all pairs of points."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topictide.operators import density as D
from topictide.operators import merge_tree as T
from topictide.operators import metric_index as X


def cloud(n, dims=4, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 6, (5, dims))
    x = centres[rng.integers(0, 5, n)] + rng.normal(0, 1, (n, dims)) * rng.choice([0.2, 0.6, 1.5], (n, 1))
    x[: n // 10] = rng.uniform(-15, 15, (n // 10, dims))
    return np.vstack([x, np.repeat(x[n // 2:n // 2 + 1], 9, axis=0), x[:7]])  # copies, some more than min_samples


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, embedding array<double>").repartition(5)


def reachability(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, k - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    reach[d == 0] = 0.0  # copies are one point
    np.fill_diagonal(reach, np.inf)
    return reach


def merges(x, k):
    """(height, left rows, right rows) by Kruskal's rule over all pairs."""
    reach = reachability(x, k)
    i, j = np.triu_indices(len(x), 1)
    home, out = {n: n for n in range(len(x))}, []
    groups = {n: [n] for n in range(len(x))}
    for e in np.argsort(reach[i, j], kind="stable"):
        a, b = home[i[e]], home[j[e]]
        if a != b:
            out.append((reach[i[e], j[e]], list(groups[a]), list(groups[b])))
            for n in groups[b]:
                home[n] = a
            groups[a] += groups.pop(b)
    return out


def brute_clusters(x, k, least):
    """Labels by their smallest row, from the condensed tree written down by its definition."""
    tree = merges(x, k)
    children, kept, born, gain, rows = {}, {}, {0: 0.0}, {0: 0.0}, {0: list(range(len(x)))}
    density = lambda h: 1 / max(h, 1e-9)
    cluster_of, last = {n: 0 for n in range(len(x))}, 1
    for height, a, b in reversed(tree):
        c = cluster_of[a[0]]
        if c is None:
            continue
        if len(a) >= least and len(b) >= least:
            children[c] = []
            for part in (a, b):
                gain[c] += len(part) * (density(height) - born[c])
                born[last], gain[last], rows[last] = density(height), 0.0, list(part)
                for n in part:
                    cluster_of[n] = last
                children[c].append(last)
                last += 1
        else:
            for part in (a, b):
                if len(part) < least or len(a) < least and len(b) < least:
                    gain[c] += len(part) * (density(height) - born[c])
                    for n in part:
                        cluster_of[n] = None
    best, chosen = {}, set()
    for c in sorted(gain, reverse=True):
        below = sum(best[k] for k in children.get(c, []))
        best[c] = max(gain[c], below)
        if c and (c not in children or gain[c] >= below):
            chosen.add(c)
    out, todo = [-1] * len(x), [0]
    while todo:
        c = todo.pop()
        if c in chosen:
            for n in rows[c]:
                out[n] = min(rows[c])
        else:
            todo += children.get(c, [])
    return out


@pytest.mark.parametrize("block_rows, task_edges", [(1_000, 300_000), (40, 60)])
def test_merges_equal_those_of_all_pairs(spark, block_rows, task_edges):
    x = cloud(484)
    got = D.merge_levels(frame(spark, x), 6, block_rows, task_edges).toPandas()
    copies = len(x) - len(np.unique(x, axis=0))
    want = merges(x, 6)
    assert len(got) == len(x) - copies - 1 and copies > 10
    np.testing.assert_allclose(sorted(got.height), sorted(h for h, _, _ in want)[copies:], rtol=1e-9)
    sizes = sorted((round(h, 6), *sorted((len(a), len(b)))) for h, a, b in want)[copies:]
    once = {h for h, n in pd.Series([h for h, *_ in sizes]).value_counts().items() if n == 1}  # ties merge in any order
    assert {s for s in zip(got.height.round(6), got.smaller, got.larger) if s[0] in once} == {s for s in sizes if s[0] in once}


@pytest.mark.parametrize("k, block_rows, task_edges, least", [(1, 1_000, 300_000, 12), (1, 50, 80, 12), (1, 50, 80, 5), (5, 50, 300_000, 20)])
def test_clusters_equal_those_of_all_pairs(spark, k, block_rows, task_edges, least):
    x = cloud(400, 3, seed=8)[:400]
    got = {r.row_id: r.cluster for r in D.hierarchical_clusters(frame(spark, x), k, least, block_rows, task_edges).collect()}
    want = brute_clusters(x, k, least)
    same = sum(got[i] == want[i] for i in range(len(x)))
    # Core distances make ties: a point at whose core distance two clusters meet may go to either.
    assert len(set(want)) > 2 and same >= (len(x) if k == 1 else len(x) - 8)


def test_copies_that_are_a_cluster(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([np.repeat([[0.0, 0.0]], 40, axis=0), rng.normal(20, 1, (60, 2)), [[9.0, 9.0]]])
    got = {r.row_id: r.cluster for r in D.hierarchical_clusters(frame(spark, x), 5, 30).collect()}
    assert {got[i] for i in range(40)} == {0} and {got[i] for i in range(40, 100)} == {40}


@pytest.mark.parametrize("x", [np.zeros((0, 2)), np.ones((1, 2)), np.ones((9, 2)), np.arange(8.0).reshape(4, 2)])
def test_too_few_points_are_noise(spark, x):
    got = D.hierarchical_clusters(frame(spark, x) if len(x) else spark.createDataFrame([], "row_id long, embedding array<double>"), 5, 3)
    assert [r.cluster for r in got.collect()] == [-1] * len(x)


def test_no_near_pair_of_points_is_ruled_out(spark):
    x = cloud(600)
    points = D.unique_points(frame(spark, x))[0]
    index = X.build(points, 30)
    where = {r.point: r.id >> 32 for r in D.named_points(index).collect()}
    rows = points.collect()
    vectors = np.array([r.embedding for r in rows])
    d = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(2))
    block = np.array([where[r.point] for r in rows])
    assert np.bincount(block).max() <= 60 and index.n_points == len(rows)
    kept = 0
    for a in range(index.n_blocks):
        least = index.summary.least_distances(a)
        for b in range(index.n_blocks):
            between = d[np.ix_(block == a, block == b)]
            assert not between.size or least[b] <= between.min()
            kept += least[b] <= 1.0
    assert kept < index.n_blocks ** 2 / 2  # it rules out most of them
    pairs = {(r.a, r.b) for r in X.block_pairs(index, lambda a, b, least: least <= 1.0).collect()}
    assert pairs == {(a, b) for a in range(index.n_blocks) for b in range(a, index.n_blocks) if index.summary.least_distances(a)[b] <= 1.0}


def test_choice_by_level_equals_choice_in_one_task(spark):
    rng = np.random.default_rng(6)
    parent = [None] + [int(rng.integers(0, i)) for i in range(1, 60)]
    tree = spark.createDataFrame([(i, p, float(rng.random() * 5)) for i, p in enumerate(parent)], "cluster long, parent long, own double")
    small, large = (sorted(tuple(r) for r in T.chosen_clusters(tree, limit).select("cluster", "pick").collect()) for limit in (1_000, 1))
    assert small == large and len({p for _, p in small}) > 3


def test_a_block_moves_once_for_each_group(spark):
    """Where all blocks have to meet, rows dealt are blocks times groups, not pairs of blocks."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (1_200, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = X.build(D.unique_points(frame(spark, x))[0], 8)
    assert index.n_blocks > 4 * X.GROUPS

    def seen(blocks, pairs):
        return pa.table({"blocks": [len(blocks)], "a": [[p[0] for p in pairs]], "b": [[p[1] for p in pairs]]})

    needed = lambda a, b, least: least <= 1.2
    tiles = X.meeting(index, needed, seen, "blocks long, a array<long>, b array<long>").collect()
    met = [p for t in tiles for p in zip(t.a, t.b)]
    assert len(met) == len(set(met)) and set(met) == {(r.a, r.b) for r in X.block_pairs(index, needed).collect()}
    assert len(met) > index.n_blocks ** 2 / 4  # nothing is far enough to be left out
    assert sum(t.blocks for t in tiles) <= index.n_blocks * (X.GROUPS + 1)
