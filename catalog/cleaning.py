"""Sources, sinks and cleaning: queries and checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.views import (
    DOCS, EVENTS, ORDERS, embeddings_planted, posts_docs, posts_events, posts_orders, r6, register, table, with_)
from topictide.operators import cleaning as C
from topictide.runtime import scratch_path
from topictide.sources import readers as R
from topictide.sources.writers import save

# --- sources and sinks ------------------------------------------------------------

DOC_CSV = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("text", T.StringType()),
                        T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType())])


@register("S01_posts_csv", """
SELECT doc_id AS row_id, md5(text) AS text_md5, lang, n_chars FROM documents""")
def _csv(spark, sf):
    path = scratch_path(spark)
    save(table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang", "n_chars"), path, "csv")
    return R.read_posts_csv(spark, path, DOC_CSV).select("row_id", F.md5("text").alias("text_md5"), "lang", "n_chars")


@register("S02_embeddings_source", f"""
WITH e AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT row_id, CAST(len(v) AS INTEGER) AS dims, {r6('list_sum(v) AS total', 'sqrt(list_inner_product(v, v)) AS norm')} FROM e""")
def _embeddings(spark, sf):
    path = scratch_path(spark)
    save(table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding"), path)
    add = lambda f: F.aggregate("embedding", F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    return R.read_embeddings(spark, path).select(
        "row_id", F.size("embedding").alias("dims"), add(lambda x: x).alias("total"), F.sqrt(add(lambda x: x * x)).alias("norm"))


@register("S03_aligned_posts", with_(DOCS, final="""
SELECT p.row_id, p.cluster, CAST(len(e.embedding) AS INTEGER) AS dims FROM posts p JOIN embeddings e ON p.row_id = e.vec_id"""))
def _align(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    posts = posts_docs(spark, sf)
    whole = posts.join(R.unaligned(posts, vectors).select("row_id"), "row_id", "left_anti")
    return R.align(whole, vectors).select("row_id", "cluster", F.size("embedding").alias("dims"))


@register("S03_unaligned_posts", with_(DOCS, final="""
SELECT row_id, cluster FROM posts p WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = p.row_id)"""))
def _unaligned(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    return R.unaligned(posts_docs(spark, sf), vectors).select("row_id", "cluster")


CLUSTER_CSV = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("cluster", T.IntegerType()),
                            T.StructField("text", T.StringType())])


@register("S05_clusters_csv_fallback", with_(EVENTS, final="SELECT row_id, cluster, text FROM posts"))
def _fallback(spark, sf):
    path = scratch_path(spark)
    save(posts_events(spark, sf).select("row_id", "cluster", "text"), path, "csv")
    return R.read_clusters(spark, path + "-missing", path, CLUSTER_CSV)


@register("S04_clusters_parquet", with_(EVENTS, final="SELECT row_id, cluster, text FROM posts"))
def _parquet(spark, sf):
    path = scratch_path(spark)
    save(posts_events(spark, sf).select("row_id", "cluster", "text"), path)
    return R.read_clusters(spark, path)


@register("S08_engagement_columns", f"""
SELECT event_id AS row_id, {r6('coalesce(TRY_CAST(v AS DOUBLE), 0.0) AS likes')}, 0.0::DOUBLE AS reach,
       {r6('CAST(user_id AS DOUBLE) AS shares', 'coalesce(TRY_CAST(props AS DOUBLE), 0.0) AS comments')}
FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS v FROM events)""")
def _engagement(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("X Likes"),
        F.col("user_id").cast("double").alias("shares"), F.col("props").alias("Facebook Comments"))
    return R.normalize_engagement(e).select("row_id", "likes", "reach", "shares", "comments")


@register("S09_cluster_output", """
SELECT vec_id AS row_id, CAST(label AS INTEGER) AS cluster, CAST(vec_id AS VARCHAR) AS text,
       md5(CAST(label AS VARCHAR)) AS "cluster_label" FROM embeddings""")
def _output(spark, sf):
    e = embeddings_planted(spark, sf).select(
        "row_id", F.col("label").cast("int").alias("cluster"), F.col("row_id").cast("string").alias("text"),
        F.md5(F.col("label").cast("string")).alias("cluster_label"), "embedding", F.lit("x").alias("unrelated"))
    return R.cluster_output(e)


for _fmt in ("parquet", "csv", "json"):
    @register(f"S10_sink_{_fmt}_kept", with_(EVENTS, final="""
SELECT cluster, CAST(count(*) AS BIGINT) AS posts, min(text) AS first_text FROM posts GROUP BY 1"""))
    def _sink(spark, sf, fmt=_fmt):
        path, rows = scratch_path(spark), posts_events(spark, sf).select("row_id", "cluster", "text")
        save(rows, path, fmt)
        save(rows.withColumn("cluster", F.lit(99)), path, fmt)  # exists: must change nothing
        back = spark.read.schema(CLUSTER_CSV).option("header", True).format(fmt).load(path)
        return back.groupBy("cluster").agg(F.count(F.lit(1)).alias("posts"), F.min("text").alias("first_text"))


@register("S10_sink_forced", with_(EVENTS, final="""
SELECT cluster + 100 AS cluster, CAST(count(*) AS BIGINT) AS posts FROM posts GROUP BY 1"""))
def _forced(spark, sf):
    path, rows = scratch_path(spark), posts_events(spark, sf).select("row_id", "cluster")
    save(rows, path)
    save(rows.withColumn("cluster", F.col("cluster") + 100), path, force=True)
    return spark.read.parquet(path).groupBy("cluster").agg(F.count(F.lit(1)).alias("posts"))


# --- cleaning ---------------------------------------------------------------------

@register("P01_engagement_score", with_(ORDERS, final=f"""
SELECT row_id, {r6('coalesce(likes, 0) + coalesce(shares, 0) AS engagement')} FROM posts"""))
def _score(spark, sf):
    posts = posts_orders(spark, sf)
    return posts.select("row_id", C.engagement_score(posts).alias("engagement"))


DEDUPED = [*DOCS, ("deduped", """
SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY text, author ORDER BY likes DESC, row_id) = 1""")]
TEXT_ONLY = """
SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY text ORDER BY likes DESC, row_id) = 1"""


@register("P02_exact_duplicates", with_(DEDUPED, final=f"""
SELECT row_id, author, cluster, md5(text) AS text_md5, {r6('likes')} FROM deduped"""))
def _dedup(spark, sf):
    return C.deduplicate_exact(posts_docs(spark, sf)).select("row_id", "author", "cluster", F.md5("text").alias("text_md5"), "likes")


def capped_sql(source: str) -> str:
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY likes DESC, row_id) AS rn FROM {source} WHERE author IS NOT NULL)
WHERE rn <= greatest(1, CAST(floor((SELECT count(*) FROM {source}) * 0.05) AS BIGINT))"""


@register("P03_author_cap", with_(EVENTS, [("capped", capped_sql("posts"))], final=f"""
SELECT row_id, author, cluster, {r6('likes')} FROM capped"""))
def _cap(spark, sf):
    return C.cap_authors(posts_events(spark, sf)).select("row_id", "author", "cluster", "likes")


CLEANED = [*DEDUPED, ("capped", capped_sql("deduped"))]


@register("P04_cleaning_report", with_(CLEANED, final="""
SELECT a AS rows_input, c AS rows_output, a - b AS exact_duplicates_removed, b - c AS author_cap_removed, a - c AS total_removed,
       round(100.0::DOUBLE * (a - c) / greatest(a, 1), 2) AS removal_pct, 0.05::DOUBLE AS author_cap_share
FROM (SELECT (SELECT count(*) FROM posts) AS a, (SELECT count(*) FROM deduped) AS b, (SELECT count(*) FROM capped) AS c)"""))
def _report(spark, sf):
    return C.clean_posts(posts_docs(spark, sf))[1]


@register("P04_cleaned_posts", with_(CLEANED, final=f"SELECT row_id, author, cluster, {r6('likes')} FROM capped"))
def _cleaned(spark, sf):
    return C.clean_posts(posts_docs(spark, sf))[0].select("row_id", "author", "cluster", "likes")


@register("P05_kept_row_ids", with_(CLEANED, final="SELECT row_id FROM capped"))
def _kept(spark, sf):
    return C.kept_row_ids(C.clean_posts(posts_docs(spark, sf))[0])


@register("P06_duplicates_without_author", with_(DOCS, [("deduped", TEXT_ONLY)], final=f"""
SELECT row_id, md5(text) AS text_md5, {r6('likes')} FROM deduped"""))
def _text_only(spark, sf):
    posts = posts_docs(spark, sf).drop("author")
    return C.deduplicate_exact(posts, author_col=C.author_column(posts)).select("row_id", F.md5("text").alias("text_md5"), "likes")
