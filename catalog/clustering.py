"""Dimension reduction, density clusters and map coordinates: queries and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.views import PLANTED, embeddings_planted, register, table, with_
from topictide.operators import density as D
from topictide.operators import projection as P
from topictide.runtime import materialize

RAW = [("points", "SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings")]


def flat_sql(radius: float, min_samples: int, min_size: int) -> list:
    return [
        ("near", f"SELECT a.row_id AS a, b.row_id AS b FROM points a JOIN points b ON list_distance(a.embedding, b.embedding) <= {radius}"),
        ("cores", f"SELECT a AS node FROM near GROUP BY 1 HAVING count(*) >= {min_samples}"),
        ("links", "SELECT a, b FROM near WHERE a IN (SELECT node FROM cores) AND b IN (SELECT node FROM cores)"),
        ("reach(node, root)", "/* RECURSIVE_STEP */ SELECT node, node FROM cores UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node"),
        ("comp", "SELECT node, min(root) AS cluster FROM reach GROUP BY 1"),
        ("big", f"SELECT cluster FROM comp GROUP BY 1 HAVING count(*) >= {min_size}"),
    ]


FLAT_OUT = """SELECT p.row_id, CAST(coalesce(b.cluster, -1) AS BIGINT) AS cluster FROM points p
LEFT JOIN comp c ON c.node = p.row_id LEFT JOIN big b ON b.cluster = c.cluster"""


def raw(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")


for _name, _cte, _points, _args in (
    ("planted", PLANTED, embeddings_planted, (2.0, 8, 35)),
    ("sparse", PLANTED, embeddings_planted, (1.3, 8, 5)),
    ("all_noise", RAW, raw, (0.8, 8, 35)),
):
    @register(f"C02_flat_density_{_name}", with_(_cte, flat_sql(*_args), final=FLAT_OUT))
    def _flat(spark, sf, points=_points, args=_args):
        return D.flat_clusters(points(spark, sf), *args)


# The planted labels are far apart and dense within, so they are the clusters.
@register("C02_density_clusters", with_(PLANTED, final="SELECT row_id, min(row_id) OVER (PARTITION BY label) AS cluster FROM points"))
def _density(spark, sf):
    return D.density_clusters(embeddings_planted(spark, sf), [4.0, 2.0, 1.5], 8, 20)


@register("C02_hierarchical_clusters", with_(PLANTED, final="SELECT row_id, min(row_id) OVER (PARTITION BY label) AS cluster FROM points"))
def _hierarchical(spark, sf):
    return D.hierarchical_clusters(embeddings_planted(spark, sf), 8, 20).select("row_id", "cluster")


# Merges up to a height: core points less the components that they make at that radius.
LEVELS = [1.2, 1.4, 1.6, 2.0, 3.4]
LEVEL_SQL = [
    ("levels", f"SELECT unnest({LEVELS}::DOUBLE[]) AS height"),
    ("apart", "SELECT a.row_id AS a, b.row_id AS b, list_distance(a.embedding, b.embedding) AS d FROM points a JOIN points b ON true"),
    ("cores", "SELECT height, a AS node FROM apart JOIN levels ON d <= height GROUP BY ALL HAVING count(*) >= 8"),
    ("links", """SELECT x.height, x.node AS a, y.node AS b FROM apart JOIN cores x ON x.node = a JOIN cores y ON y.node = b AND y.height = x.height
        WHERE d <= x.height"""),
    ("reach(height, node, root)", """/* RECURSIVE_STEP */ SELECT height, node, node FROM cores
        UNION SELECT l.height, l.b, r.root FROM reach r JOIN links l ON l.a = r.node AND l.height = r.height"""),
    ("parts", "SELECT height, node, min(root) AS part FROM reach GROUP BY ALL"),
]


@register("C02_merge_levels", with_(PLANTED, LEVEL_SQL, final="""
SELECT levels.height, count(node) - count(DISTINCT part) AS merges FROM levels LEFT JOIN parts ON parts.height = levels.height GROUP BY ALL"""))
def _levels(spark, sf):
    found = D.merge_levels(embeddings_planted(spark, sf), 8)
    up_to = F.explode(F.array(*[F.lit(h) for h in LEVELS])).alias("level")
    return found.select("height", up_to).groupBy(F.col("level").alias("height")).agg(
        F.sum((F.col("height") <= F.col("level")).cast("long")).alias("merges"))


@register("C01_reduced_embeddings")
def _reduced(spark, sf):
    fitted = P.fit_reduction(embeddings_planted(spark, sf), 16)
    return fitted.transform(embeddings_planted(spark, sf)).select(
        "row_id", F.size("reduced").alias("dims"), F.get("reduced", F.lit(0)).alias("first"), F.lit(fitted.retained).alias("retained"))


# What principal components must be: as many as asked for, centred, uncorrelated, falling.
@register("C01_reduction_properties", """SELECT count(*) AS n, 16::BIGINT AS dims, true AS centred, true AS uncorrelated, true AS falling,
true AS shares FROM embeddings""")
def _properties(spark, sf):
    points = embeddings_planted(spark, sf)
    fitted = P.fit_reduction(points, 16)
    x = lambda i: F.get("reduced", F.lit(i))
    out = fitted.transform(points).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("reduced")).cast("long").alias("dims"), *[F.abs(F.avg(x(i))).alias(f"m{i}") for i in range(16)],
        *[F.var_samp(x(i)).alias(f"v{i}") for i in range(16)], *[F.abs(F.corr(x(i), x(i + 1))).alias(f"r{i}") for i in range(15)])
    v = [F.col(f"v{i}") for i in range(16)]
    return out.select(
        "n", "dims", (F.greatest(*[f"m{i}" for i in range(16)]) < 1e-9).alias("centred"),
        (F.greatest(*[f"r{i}" for i in range(15)]) < 1e-4).alias("uncorrelated"),
        F.expr(" and ".join(f"v{i} >= v{i + 1}" for i in range(15))).alias("falling"),
        (F.abs(v[0] / v[15] - F.lit(fitted.variance[0] / fitted.variance[15])) < 1e-6).alias("shares"))


# The planted labels are apart, so the silhouette of as many clusters is clearly above 0.
@register("C04_centroid_quality", "SELECT count(*) AS n, 10::BIGINT AS clusters, true AS separated FROM embeddings")
def _quality(spark, sf):
    found = materialize(P.centroid_clusters(embeddings_planted(spark, sf), 10).select("row_id", "embedding", "cluster"))
    value = P.silhouette(found)
    return found.agg(F.count(F.lit(1)).alias("n"), F.lit(10).cast("long").alias("clusters"), F.lit(-1.0 <= value <= 1.0 and value > 0.1).alias("separated"))


@register("C03_map_coordinates")
def _coordinates(spark, sf):
    return P.map_coordinates(embeddings_planted(spark, sf)).select("row_id", "proj_x", "proj_y")


@register("C04_centroid_clusters")
def _centroids(spark, sf):
    return P.centroid_clusters(embeddings_planted(spark, sf), 10).select("row_id", "cluster")
