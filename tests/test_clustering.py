import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topictide.operators import density as D
from topictide.operators import projection as P
from topictide.operators.graph import connected_components


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("pairs", [
    [(i, i + 1) for i in range(40)],
    [(99, i) for i in range(30)],
    [(random.Random(2).randint(0, 60), random.Random(i).randint(0, 60)) for i in range(50)],
])
def test_components(spark, pairs):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    pairs = [p for p in pairs if p[0] != p[1]]
    assert got == components(pairs, {n for p in pairs for n in p})


def test_long_path_in_order_of_ids(spark):
    edges = spark.range(5_000).selectExpr("id as a", "id + 1 as b")
    got = connected_components(edges).groupBy("component").count().collect()
    assert [tuple(r) for r in got] == [(0, 5_001)]


def brute(x, radius, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = d <= radius
    core = near.sum(1) >= k
    pairs = [(i, j) for i in range(len(x)) for j in range(i) if near[i, j] and core[i] and core[j]]
    comp = components(pairs, [i for i in range(len(x)) if core[i]])
    return [comp.get(i, -1) for i in range(len(x))]


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_flat_clusters_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.4, (25, 3)) for c in ((0, 0, 0), (2, 2, 0), (-3, 1, 1))] + [rng.uniform(-6, 6, (25, 3))])
    x = np.vstack([x, np.repeat(x[:1], 6, axis=0), np.repeat([[9.0, 9.0, 9.0]], 5, axis=0)])  # copies count as neighbours
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id long, embedding array<double>")
    got = {r.row_id: r.cluster for r in D.flat_clusters(df, 0.7, 5, block_rows=block_rows).collect()}
    assert [got[i] for i in range(len(x))] == brute(x, 0.7, 5)


def planted(spark, n=40):
    rng = np.random.default_rng(1)
    centres = [np.eye(6)[i] * 10 for i in range(3)]
    rows = [(i * n + j, i, [float(v) for v in centres[i] + rng.normal(0, 0.3, 6)]) for i in range(3) for j in range(n)]
    return spark.createDataFrame(rows, "row_id long, label int, embedding array<double>")


def test_density_clusters_recover_planted_topics(spark):
    pts = planted(spark)
    found = D.density_clusters(pts, [20.0, 4.0, 2.0, 1.0], 5, 20).join(pts, "row_id")
    pairs = found.where("cluster >= 0").select("cluster", "label").distinct().collect()
    assert len(pairs) == 3 and len({r.cluster for r in pairs}) == 3
    assert found.where("cluster = -1").count() <= 6


def test_all_noise(spark):
    assert {r.cluster for r in D.flat_clusters(planted(spark), 0.001, 3).collect()} == {-1}


def test_projection(spark):
    pts = planted(spark)
    fitted = [P.fit_reduction(pts, k) for k in (1, 2, 99)]
    assert fitted[0].retained < fitted[1].retained < fitted[2].retained <= 1 + 1e-9 and len(fitted[2].variance) == 6
    reduced = fitted[1].transform(pts)
    assert reduced.select(F.size("reduced")).first()[0] == 2
    assert abs(reduced.agg(F.avg(F.get("reduced", F.lit(0)))).first()[0]) < 1e-6  # centred
    xy = P.map_coordinates(pts)
    assert xy.where("proj_x IS NULL OR proj_y IS NULL").count() == 0 and set(pts.columns) < set(xy.columns)


def test_centroid_clusters(spark):
    out = P.centroid_clusters(planted(spark), 3)
    assert out.groupBy("cluster").agg(F.countDistinct("label").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("rows, dims, k", [(300, 40, 5), (60, 200, 12), (500, 7, 7)])
def test_reduction_equals_the_full_decomposition(spark, rows, dims, k):
    rng = np.random.default_rng(rows)
    x = rng.normal(0, 1, (rows, dims)) * np.linspace(3, 0.5, dims) + rng.normal(0, 5, dims)
    fitted = P.fit_reduction(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, embedding array<double>").repartition(4), k)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    np.testing.assert_allclose(fitted.variance, (s / s.sum())[:k], atol=1e-6)
    assert abs(fitted.retained - s[:k].sum() / s.sum()) < 1e-6
    np.testing.assert_allclose(fitted.components.T @ fitted.components, np.eye(k), atol=1e-8)


def test_silhouette(spark):
    pts = planted(spark)
    good = P.silhouette(pts.withColumnRenamed("label", "cluster"))
    bad = P.silhouette(pts.withColumn("cluster", (F.col("row_id") % 3).cast("int")))
    assert good > 0.9 > 0.2 > bad
