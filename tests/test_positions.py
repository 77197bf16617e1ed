"""Places by prefix sums, and the cut by counts, against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from topictide.operators import themes as H
from topictide.operators.positions import positioned
from topictide.operators.ranking import most_frequent


@pytest.mark.parametrize("range_rows", [None, 7, 1_000])
def test_positions_of_sparse_ids_and_null_keys(spark, range_rows):
    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, 2, None]), r.randrange(10**15), "x") for _ in range(300)]
    df = spark.createDataFrame(rows, "k int, id long, position_ string").repartition(6)
    got = {(x.k, x.id): x.position for x in positioned(df, ["k"], "id", range_rows).collect()}
    for key in (1, 2, None):
        ids = sorted(i for k, i, _ in rows if k == key)
        assert [got[key, i] for i in ids] == list(range(len(ids)))
    assert len(got) == 300


def test_same_documents_and_bigrams_for_dense_and_sparse_ids(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "the"]) for _ in range(r.randint(0, 4))) for _ in range(80)]
    rows = [(i, t, i % 2) for i, t in enumerate(texts)]
    posts = spark.createDataFrame(rows, "row_id long, text string, cluster int").withColumn("timestamp", F.expr("timestamp_ntz'2024-03-05 00:00:00'"))
    far = posts.withColumn("row_id", F.expr("row_id * row_id * 1000003 - 5000000000"))
    parts = [sorted((x.cluster, x.part, x.document, x.source_posts) for x in H.documents(p, part_rows=6).collect()) for p in (posts, far)]
    assert parts[0] == parts[1] and {n for _, _, _, n in parts[0]} == {6, 4}
    terms = [sorted(tuple(x) for x in H.document_terms(p, chunk_rows=c).collect()) for p in (posts, far) for c in (None, 5)]
    assert terms[0] == terms[1] == terms[2] == terms[3]


@pytest.mark.parametrize("most", [1, 10, 55, 199, 200, 500])
def test_most_frequent(spark, most):
    r = random.Random(1)
    rows = [(f"t{i:03d}", r.choice([1, 2, 2, 3, 40, 41, r.randint(1, 5_000)])) for i in range(200)]
    got = {tuple(x) for x in most_frequent(spark.createDataFrame(rows, "term string, n long"), "n", "term", most).collect()}
    assert got == set(sorted(rows, key=lambda x: (-x[1], x[0]))[:most])


def test_most_frequent_where_a_class_of_counts_ends_at_the_last_row(spark):
    rows = [(f"t{i:03d}", 1000 if i < 5 else 1) for i in range(40)]
    got = {tuple(x) for x in most_frequent(spark.createDataFrame(rows, "term string, n long"), "n", "term", 5).collect()}
    assert got == set(rows[:5])


def test_map_sample_is_the_rows_with_the_smallest_hashes(spark):
    import hashlib

    from topictide.plans import reports as R

    points = spark.range(3000).selectExpr("id as row_id", "id % 3 as cluster")
    got = {r.row_id for r in R.map_sample(points, 400).collect()}
    assert got == set(sorted(range(3000), key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i))[:400])
