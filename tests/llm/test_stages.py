"""Stages of the pipeline by row, not by id."""

from topictide.llm import stages


def test_texts_under_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (8, d + " more"), (9, c), (None, c), (None, None), (None, ""), (3, "x y"), (3, "z")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n_chars long").repartition(3)
    docs = docs.unionAll(docs.where("doc_id = 3"))
    left = sorted((str(r.doc_id), str(r.text)) for r in stages.distinct_documents(spark, docs, "").collect())
    assert left == sorted((str(i), str(t)) for i, t in [(None, a), (None, b), (7, c), (7, d), (None, None), (None, ""), (3, "x y"), (3, "z")])


def test_benchmark_passages_go_by_row(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(14))
    rows = [(None, "clean text one"), (None, f"before {passage} after"), (7, "clean text two"), (7, passage), (8, None), (9, passage), (10, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n_chars long").repartition(3)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = sorted((str(r.doc_id), str(r.text)) for r in stages.uncontaminated(spark, docs, str(tmp_path)).collect())
    assert left == sorted((str(i), str(t)) for i, t in [(None, "clean text one"), (7, "clean text two"), (8, None), (10, "")])


def test_rules_don_t_depend_on_which_of_several_labels_comes_first(spark):
    import random

    from topictide.llm import quality_rules

    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["aa", "bbb", "c#", "d%"]) if i % 3 == 0 else r.choice(["aaa", "bbbb", "cc"]) for _ in range(40))) for i in range(300)]
    stats = quality_rules.text_statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = [(i, int(i % 3 > 0)) for i in range(300)] + [(i, 0) for i in range(300) if i % 3 and i % 5 == 0] + [(None, 1)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, quality int")
    one, other = (quality_rules.train(stats, frame(x)) for x in (labels, labels[::-1]))
    assert one == other and one
