import random

from pyspark.sql import functions as F

from topictide.operators import cleaning as C
from topictide.operators.ranking import kth_smallest

COLS = "row_id long, text string, Author string, timestamp string, `X Likes` int, `X Reposts` int"


def test_highest_engagement_copy_is_kept(spark):
    df = spark.createDataFrame([
        (0, "hello world", "alice", "2024-01-01", 1, 0), (1, "hello world", "alice", "2024-01-02", 5, 0),
        (2, "hello world", "bob", "2024-01-01", 2, 0), (3, "other", "alice", "2024-01-01", 0, 0)], COLS)
    rows = C.deduplicate_exact(df, author_col="Author").orderBy("row_id").collect()
    assert [r.row_id for r in rows] == [1, 2, 3] and rows[0]["X Likes"] == 5


def test_ties_take_lowest_row_and_null_authors_are_equal(spark):
    df = spark.createDataFrame([(3, "a", None, 1.0), (1, "a", None, 1.0), (2, "a", "x", None)],
                               "row_id long, text string, author string, likes double")
    assert sorted(r.row_id for r in C.deduplicate_exact(df).collect()) == [1, 2]


def test_author_cap_keeps_best_posts(spark):
    rows = [(i, f"s{i}", "spammer", "2024-01-01", i + 1, 0) for i in range(20)]
    rows += [(100 + i, f"t{i}", f"user{i}", "2024-01-01", 1, 0) for i in range(80)]
    kept = C.cap_authors(spark.createDataFrame(rows, COLS), "Author", 0.05)
    spam = sorted((r["X Likes"] for r in kept.where("Author = 'spammer'").collect()), reverse=True)
    assert spam == [20, 19, 18, 17, 16] and kept.count() == 85


def test_author_cap_drops_null_authors_and_breaks_ties_by_row(spark):
    rows = [(i, f"t{i}", "hot", 0.0) for i in range(60)] + [(100, "x", None, 9.0)]
    df = spark.createDataFrame(rows, "row_id long, text string, author string, likes double")
    kept = C.cap_authors(df, max_share=0.1)
    assert sorted(r.row_id for r in kept.collect()) == list(range(6))


def test_report(spark):
    df = spark.createDataFrame([
        (0, "a", "u", "2024-01-01", 1, 0), (1, "a", "u", "2024-01-01", 2, 0), (2, "b", "v", "2024-01-01", 1, 0)], COLS)
    kept, report = C.clean_posts(df, author_col="Author", max_share=0.9)
    r = report.first()
    assert (r.rows_input, r.rows_output, r.exact_duplicates_removed, r.author_cap_removed) == (3, 2, 1, 0)
    assert r.removal_pct == 33.33 and kept.count() == 2 and C.kept_row_ids(kept).count() == 2


def test_missing_author_column_means_text(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a")], "row_id long, text string")
    assert C.author_column(df) == "text"
    assert [r.row_id for r in C.deduplicate_exact(df, author_col="text").collect()] == [0]


def test_non_numeric_engagement_counts_zero(spark):
    df = spark.createDataFrame([("x", "2"), (None, "3.5")], "likes string, shares string")
    got = [r.e for r in df.select(C.engagement_score(df).alias("e")).collect()]
    assert got == [2.0, 3.5]


def test_kth_smallest_matches_brute_force(spark):
    rnd = random.Random(7)
    data = [("a", float(rnd.choice([0, 0, 0, 1, 2, rnd.random()])), i) for i in range(500)] + [("b", float(i % 3), i) for i in range(50)]
    data += [("c", 0.0, i) for i in range(300)] + [("d", 1.0, 7)] * 90
    df = spark.createDataFrame(data, "key string, v double, row long")
    for ks in ((1, 1, 1, 1), (37, 20, 150, 50), (500, 50, 300, 90)):
        wanted = spark.createDataFrame(list(zip("abcd", ks)), "key string, k long")
        for sort_rows in (20, 10_000):
            got = {r.key: (r.cutoff, r.tie_cutoff) for r in kth_smallest(df, "key", "v", "row", wanted, sort_rows, bins=8).collect()}
            assert got == {key: sorted((v, r) for x, v, r in data if x == key)[k - 1] for key, k in zip("abcd", ks)}


def test_cap_equals_window_on_skewed_authors(spark):
    rnd = random.Random(3)
    rows = [(i, f"t{i}", "hot" if i % 3 == 0 else f"u{i % 50}", float(rnd.randint(0, 4))) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, text string, author string, likes double")
    want = set()
    for a in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == a), key=lambda r: (-r[3], r[0]))
        want |= {r[0] for r in mine[:max(1, int(900 * 0.05))]}
    assert {r.row_id for r in C.cap_authors(df).collect()} == want
    assert C.cap_authors(df).where(F.col("author") == "hot").count() == 45
