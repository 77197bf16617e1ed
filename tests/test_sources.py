import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topictide.schemas import require_columns
from topictide.sources import readers as R
from topictide.sources.writers import save

SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("text", T.StringType())])


def test_csv_round_trip_keeps_quotes_and_newlines(spark, tmp_path):
    rows = [(0, 'say "hi", now'), (1, "two\nlines"), (2, None), (3, "back\\slash")]
    save(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "x"), "csv")
    back = R.read_posts_csv(spark, str(tmp_path / "x"), SCHEMA)
    assert sorted((r.row_id, r.text) for r in back.collect()) == rows
    with pytest.raises(ValueError):
        R.read_posts_csv(spark, "x", T.StructType([SCHEMA["text"]]))


def test_existing_output_is_kept_unless_forced(spark, tmp_path):
    path = str(tmp_path / "y")
    save(spark.range(3), path)
    save(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3
    save(spark.range(5), path, force=True)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError):
        save(spark.range(1), path, "xlsx")


def test_fallback_to_csv(spark, tmp_path):
    path = str(tmp_path / "z")
    save(spark.createDataFrame([(1, "a")], SCHEMA), path, "csv")
    assert R.read_clusters(spark, path + "-none", path, SCHEMA).first().text == "a"
    with pytest.raises(Exception):
        R.read_clusters(spark, path + "-none")


def test_alignment(spark):
    posts = spark.createDataFrame([(0, "a"), (2, "b")], SCHEMA)
    vectors = spark.createDataFrame([(i, [1.0]) for i in range(3)], "row_id long, embedding array<float>")
    assert R.align(posts, vectors).count() == 2 and R.unaligned(posts, vectors).count() == 0
    lacking = vectors.where("row_id < 2")
    assert [r.row_id for r in R.unaligned(posts, lacking).collect()] == [2]
    with pytest.raises(Exception, match="No embedding for row 2"):
        R.align(posts, lacking).collect()
    with pytest.raises(ValueError):
        require_columns(posts, "cluster")


def test_engagement_columns(spark):
    df = spark.createDataFrame([("5", "x", 2.0)], "`X Likes` string, `Facebook Likes` string, `Reach (new)` double")
    r = R.normalize_engagement(df).first()
    assert (r.likes, r.reach, r.shares, r.comments) == (0.0, 2.0, 0.0, 0.0)  # first source present wins


def test_cluster_output_prunes_and_casts(spark):
    df = spark.range(1).select(F.col("id").alias("row_id"), F.array(F.lit(1)).alias("text"), F.lit(3).alias("cluster"), F.lit(1).alias("junk"))
    out = R.cluster_output(df)
    assert out.columns == ["row_id", "text", "cluster"] and dict(out.dtypes)["text"] == "string"
