import datetime as dt

from pyspark.sql import functions as F

from topictide.functions.windows import window_label, window_name
from topictide.operators import temporal as T
from topictide.plans import reports as R

import pytest

POSTS = "row_id long, cluster int, cluster_label string, timestamp string, author string, likes double"


def day(text):
    return dt.date.fromisoformat(text)


def labels(spark, stamps, freq, anchor=None):
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    a = F.lit(anchor).cast("timestamp_ntz") if anchor else None
    return [str(r.w) for r in df.select(window_label(F.col("t"), freq, a).alias("w")).collect()]


def test_window_labels(spark):
    stamps = ["2024-02-29 23:59:59", "2024-03-03 10:00:00", "2024-03-04 00:00:00"]
    assert labels(spark, stamps, "1M") == ["2024-02-29", "2024-03-31", "2024-03-31"]
    assert labels(spark, stamps, "1W") == ["2024-03-03", "2024-03-03", "2024-03-10"]
    assert labels(spark, stamps, "1D") == ["2024-02-29", "2024-03-03", "2024-03-04"]
    # The first bin ends with the first month, then three months each.
    assert labels(spark, ["2024-01-15", "2024-02-01", "2024-04-30", "2024-05-01"], "3M", "2024-01-15") == [
        "2024-01-31", "2024-04-30", "2024-04-30", "2024-07-31"]


def test_window_names():
    assert window_name("1ME") == "1M"
    with pytest.raises(ValueError):
        window_name("2H")


def test_gaps_infinite_growth_and_lifecycle(spark):
    rows = [(i, 1, "A", "2024-01-10", "u", 1.0) for i in range(4)] + [(9, 1, "A", "2024-03-10", "u", 1.0)]
    rows += [(20, 2, "B", "2024-01-05", None, 2.0)]
    out = {(r.cluster, r.time_window): r for r in T.temporal_stats(spark.createDataFrame(rows, POSTS)).collect()}
    feb, mar = out[1, day("2024-02-29")], out[1, day("2024-03-31")]
    assert feb.post_count == 0 and feb.volume_pct_change == -1.0 and feb.avg_likes is None
    assert mar.volume_pct_change == float("inf") and mar.lifecycle_state == "emerging"
    assert feb.market_share is None  # nobody posted in that window
    single = out[2, day("2024-01-31")]
    assert single.lifecycle_state == "stable" and single.anomaly_score == 0.0 and single.unique_authors == 0
    assert single.volume_volatility == 0.0 and single.market_share == pytest.approx(0.2)


def test_invalid_timestamps_and_missing_columns(spark):
    df = spark.createDataFrame([(0, 1, "2024-01-01"), (1, 1, "oops"), (2, 1, None)], "row_id long, cluster int, timestamp string")
    r = T.temporal_stats(df).first()
    assert r.post_count == 1 and r.unique_authors == 1 and r.total_likes == 0.0 and r.cluster_label == "1"
    with pytest.raises(ValueError):
        T.temporal_stats(df.drop("cluster"))


def test_monthly_snapshots(spark):
    df = spark.createDataFrame([
        (0, 0, "A", "2025-01-15", "u1", 10.0), (1, 0, "A", "2025-02-15", "u2", 12.0),
        (2, 1, "B", "2025-01-20", "u3", 8.0), (3, 1, "B", "2025-02-20", "u4", 7.0)], POSTS)
    snap = T.snapshots(T.temporal_stats(df))
    assert snap.columns == ["time_window", "cluster", "cluster_label", "post_count", "market_share", "volume_pct_change",
                            "volume_volatility", "volume_lead", "lifecycle_state", "anomaly_score"]
    rows = snap.collect()
    assert [(str(r.time_window), r.cluster) for r in rows] == [
        ("2025-01-31", 0), ("2025-01-31", 1), ("2025-02-28", 0), ("2025-02-28", 1)]
    assert all(r.post_count == 1 and r.market_share == 0.5 and r.lifecycle_state == "stable" for r in rows)


def weekly_posts(spark):
    start, rows = dt.date(2025, 1, 6), []
    for w in range(52):
        stamp = str(start + dt.timedelta(weeks=w))
        rows += [(len(rows), 1, "dense", stamp, "a", 1.0) for _ in range(5)]
        if w < 10:
            rows.append((10_000 + w, 2, "sparse", stamp, "b", 1.0))
    return spark.createDataFrame(rows, POSTS)


def test_weekly_density_gate_and_snapshots(spark):
    posts = weekly_posts(spark)
    gate = {r.cluster: r.is_dense for r in T.weekly_density(T.weekly_counts(posts)).collect()}
    assert gate == {1: True, 2: False}
    snap = T.weekly_snapshots(posts)
    assert {r.cluster for r in snap.collect()} == {1}
    assert snap.columns[-1] == "window_type" and {r.window_type for r in snap.collect()} == {"1W"}


def test_weekly_growth_is_clipped(spark):
    rows = [(i, 1, "x", "2025-01-06", "a", 1.0) for i in range(3)] + [(10 + i, 1, "x", "2025-01-13", "a", 1.0) for i in range(99)]
    out = T.weekly_snapshots(spark.createDataFrame(rows, POSTS)).orderBy("time_window").collect()
    assert out[1].volume_pct_change == 10.0


def test_all_noise_gives_no_weekly_rows(spark):
    df = spark.createDataFrame([(0, -1, "n", "2025-01-06", "a", 1.0)], POSTS)
    assert T.weekly_snapshots(df).count() == 0 and T.minimal_stats(df).count() == 0


def test_recent_posts_keep_time_of_day(spark):
    df = spark.createDataFrame([(0, "2024-02-29 12:00:00"), (1, "2024-02-29 11:59:59"), (2, "2025-02-28 12:00:00")],
                               "row_id long, timestamp string")
    kept = {r.row_id for r in T.recent_posts(df).collect()}
    assert kept == {0, 1, 2}
    df2 = spark.createDataFrame([(0, "2024-03-15 12:00:00"), (1, "2024-03-15 11:59:59"), (2, "2025-03-15 12:00:00")],
                                "row_id long, timestamp string")
    assert {r.row_id for r in T.recent_posts(df2).collect()} == {0, 2}


def test_sentiment(spark):
    df = spark.createDataFrame([(0, 1, "2024-01-01", "Positive"), (1, 1, "2024-01-02", "NEGATIVE"), (2, 1, "2024-01-03", None)],
                               "row_id long, cluster int, timestamp string, sentiment string")
    r = T.sentiment_distribution(df).first()
    assert (r.positive, r.neutral, r.negative) == (0.5, 0.0, 0.5)
    assert T.sentiment_distribution(df.drop("sentiment")).first().positive is None


def test_reports_on_a_tiny_table(spark):
    rows = [("2024-01-31", c, f"L{c}", 5, 0.2, 0.1, 1.0, float(c), "emerging", 2.5 if c == 3 else 0.1) for c in range(5)]
    rows += [("2024-02-29", 0, "L0", 9, 1.0, float("inf"), 2.0, 1.0, "declining", -3.0)]
    snap = spark.createDataFrame(rows, "time_window string, cluster int, cluster_label string, post_count long, market_share double, "
        "volume_pct_change double, volume_volatility double, volume_lead double, lifecycle_state string, anomaly_score double"
        ).withColumn("time_window", F.col("time_window").cast("date"))
    assert str(R.best_window(snap).first().latest_window) == "2024-01-31"
    assert str(R.best_window(snap, 9).first().latest_window) == "2024-02-29"
    k = R.kpis(snap).first()
    assert (k.active_clusters, k.emerging_count, k.declining_count, k.event_spikes) == (5, 5, 0, 1)
    assert R.sanitized(snap).where("volume_pct_change IS NULL").count() == 1
    assert [r.cluster for r in R.top_anomalous(R.cluster_table(snap), 2).collect()] == [3, 0]
    drill = R.drill_down(snap, 0).collect()
    assert [r.time_window for r in drill] == ["2024-01", "2024-02"]
    matrix = R.metric_matrix(snap, [0, 1], "post_count").orderBy("time_window").collect()
    assert (matrix[1].cluster_0, matrix[1].cluster_1) == (9, None)
    assert [r.cluster for r in R.ranked_by(R.cluster_table(snap), "volume_lead", descending=False).collect()] == [0, 1, 2, 3, 4]


def test_scenario_comparison_fills_missing_windows(spark):
    trends = spark.createDataFrame([(1, 0, "2024-01-31", 5), (1, 2, "2024-01-31", 2), (2, 0, "2024-02-29", 3)],
                                   "event_id long, cluster int, time_window string, post_count long")
    got = {r.time_window: (r.scenario_1, r.scenario_2) for r in R.scenario_comparison(trends, [1, 2]).collect()}
    assert got == {"2024-01-31": (7, 0), "2024-02-29": (0, 3)}


def test_map_sample_is_repeatable(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id")
    a, b = ({r.row_id for r in R.map_sample(df, 50).collect()} for _ in range(2))
    assert a == b and len(a) == 50 and R.map_sample(df, 1000).count() == 500
