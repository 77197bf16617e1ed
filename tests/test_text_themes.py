import collections
import json
import math
import random

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from topictide.functions import text as X
from topictide.operators import labels as L
from topictide.operators import themes as H
from topictide.sources.lexicon import Lexicon, load_lexicon


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_stop_list_is_the_library_default(spark):
    assert sorted(X.ENGLISH_STOP_WORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))


def test_noise_tokens(spark):
    assert one(spark, X.strip_noise_tokens(F.lit("deepmind owq9fagevl 5tjwz1kzcf artificial intelligence london"))) == (
        "deepmind artificial intelligence london")
    assert one(spark, X.strip_noise_tokens(F.lit("alphafold protein structure deepmind"))) == "alphafold protein structure deepmind"
    terms = F.array(*[F.lit(t) for t in ["deepmind", "owq9fagevl", "protein", "lrvqaf3vww", "ai"]])
    assert one(spark, X.clean_label(terms)) == "deepmind, protein, ai"
    assert one(spark, X.clean_label(F.array(F.lit("https"), F.lit("123")))) == "unlabelled"


def test_normalisation(spark):
    assert one(spark, X.normalized(F.lit("It's NOT the Thor-42 café, via AMP"))) == "thor 42 caf"
    assert one(spark, X.normalized(F.lit(None).cast("string"))) == ""


POSTS = "row_id long, cluster int, cluster_label string, timestamp string, text string"


def random_posts(spark, n=120, seed=1):
    rnd = random.Random(seed)
    words = "alpha beta gamma delta the and of omega".split()
    rows = [(i, rnd.randint(0, 2), "L", f"2024-0{rnd.randint(1, 3)}-1{rnd.randint(0, 9)}",
             None if rnd.random() < .1 else " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6)))) for i in range(n)]
    return spark.createDataFrame(rows, POSTS), rows


def whole_documents(rows):
    docs = collections.defaultdict(list)
    for r in sorted(rows):
        docs[r[1], r[3][:7]].append(r[4] or "")
    return {k: [t for t in " ".join(v).split() if t not in X.DOCUMENT_STOP_WORDS] for k, v in docs.items()}


@pytest.mark.parametrize("chunk", [3, 1000])
def test_document_terms_equal_those_of_the_joined_text(spark, chunk):
    posts, rows = random_posts(spark)
    got = {(r.cluster, str(r.time_window)[:7], r.term): r.tf for r in H.document_terms(posts, chunk_rows=chunk).collect()}
    want = collections.Counter()
    for (c, w), toks in whole_documents(rows).items():
        for t in toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]:
            want[c, w, t] += 1
    assert got == dict(want)


def test_parts_join_to_the_whole_document(spark):
    posts, _ = random_posts(spark)
    key = lambda r: (r.cluster, r.time_window)
    whole = {key(r): r.document for r in H.documents(posts, part_rows=10_000).collect()}
    parts = collections.defaultdict(list)
    for r in H.documents(posts, part_rows=7).orderBy("cluster", "time_window", "part").collect():
        parts[key(r)].append(r.document)
    assert {k: " ".join(v) for k, v in parts.items()} == whole


def test_tfidf_matches_formula(spark):
    posts, rows = random_posts(spark)
    docs = whole_documents(rows)
    targets = H.window_targets(posts)
    model = H.Tfidf(posts, targets, min_df=2, max_df=1.0)
    got = {(r.cluster, str(r.time_window)[:7], r.term): r.weight for r in model.weights().collect()}
    tf = {k: collections.Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])]) for k, t in docs.items()}
    df = collections.Counter(t for c in tf.values() for t in c)
    n = len(docs)
    for k, counts in tf.items():
        w = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in counts.items() if df[t] >= 2}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            assert got.pop((*k, t)) == pytest.approx(v / norm)
    assert not got


def test_targets_without_posts_score_zero(spark):
    posts, _ = random_posts(spark)
    extra = spark.sql("SELECT 9 AS cluster, DATE '2024-01-31' AS time_window")
    targets = H.window_targets(posts).select("cluster", "time_window").unionByName(extra)
    lex = Lexicon(({"id": 1, "name": "n", "keywords": ["alpha"]},))
    scores = H.Tfidf(posts, targets, max_df=1.0).theme_scores(lex)
    assert scores.where("cluster = 9").first().score == 0.0
    parts = H.attach_documents(extra, posts).first()
    assert (parts.document, parts.source_posts, parts.part) == ("", 0, 0)
    with pytest.raises(ValueError):
        H.resolve_targets("other", targets)


def test_topic_labels(spark):
    rows = [(i, 0, None, "2024-01-01", t) for i, t in enumerate(
        ["protein folding rocks", "protein folding today", "folding news", "chess"])]
    rows += [(10, 1, None, "2024-01-01", "unique words"), (11, -1, None, "2024-01-01", "noise noise")]
    got = {r.cluster: r.cluster_label for r in L.cluster_labels(spark.createDataFrame(rows, POSTS)).collect()}
    assert got == {0: "folding, protein", 1: "Cluster 1", -1: "Uncategorized/Noise"}


def activations(spark):
    names = {0: "deepmind ai", 1: "protein folding", 2: "nhs data"}
    scores = {0: (0.8, 0.1, 0.05), 1: (0.1, 0.9, 0.05), 2: (0.05, 0.05, 0.85)}
    rows = [(c, names[c], w, t, s) for c in names for w in ("2024-01-31", "2024-02-29") for t, s in enumerate(scores[c])]
    return spark.createDataFrame(rows, "cluster int, cluster_label string, time_window string, theme_id int, score double")


def test_theme_topic_map(spark):
    lex = Lexicon(tuple({"id": i, "name": f"T{i}"} for i in range(4)))
    table = H.theme_cluster_map(activations(spark), lex)
    got = {r.theme_id: r for r in table.collect()}
    assert [got[i].cluster_id for i in range(4)] == [0, 1, 2, None]
    assert got[0].avg_score == pytest.approx(0.8) and got[3].avg_score == 0.0
    assert [r.theme_id for r in H.unmatched_themes(table).collect()] == [3]
    assert {r.cluster: r.theme_name for r in H.cluster_theme_names(table).collect()} == {0: "T0", 1: "T1", 2: "T2"}


def test_activation_thresholds_and_wide_view(spark):
    lex = Lexicon(tuple({"id": i, "name": f"T{i}"} for i in range(3)))
    active = H.activate(activations(spark), lex, {"1": 0.95}, 0.1)
    wide = {(r.cluster, r.time_window): r for r in H.wide(active, lex).collect()}
    row = wide[1, "2024-01-31"]
    assert (row.theme_0, row.theme_1, row.theme_2) == (1, 0, 0) and row.theme_1_score == 0.9
    assert H.average_active(active).first().units == 6


def test_lexicon_errors_and_files(spark, tmp_path):
    with pytest.raises(ValueError):
        Lexicon(())
    with pytest.raises(ValueError):
        Lexicon(({"name": "no id"},))
    path = tmp_path / "lexicon.json"
    path.write_text(json.dumps({"themes": [{"id": 7, "name": "The Seven", "keywords": ["A thor", "THOR"], "phrases": ["a thor"]}]}))
    lex = load_lexicon(str(path))
    assert [(r.theme_id, r.term) for r in lex.terms(spark).collect()] == [(7, "thor")]
    empty = tmp_path / "empty.yaml"
    empty.write_text("themes: []")
    with pytest.raises(ValueError):
        load_lexicon(str(empty))
    assert [r.term for r in Lexicon(({"id": 1, "name": "Only Name"},)).terms(spark, []).collect()] == ["only name"]


def test_pairs_that_no_vocabulary_holds_are_not_counted(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, i % 3, "L", f"2024-0{1 + i % 4}-11", "often seen " * 3 + " ".join(rnd.choices(words, range(300, 0, -1), k=60))) for i in range(240)]
    posts = spark.createDataFrame(rows, POSTS)
    targets = H.window_targets(posts)
    tfidf = H.Tfidf(posts, targets, max_df=1.0, max_features=100)
    every = H.document_terms(posts)
    want = H.vocabulary(every, F.lit(targets.count()), max_df=1.0, max_features=100)
    table = lambda df: sorted((r.term, r.df, r.total, round(r.idf, 9)) for r in df.collect())
    assert table(tfidf.vocabulary) == table(want) and "often seen" in {r.term for r in want.collect()}
    pairs = lambda df: df.where("contains(term, ' ')").count()
    assert pairs(tfidf.terms) < pairs(every) / 3


def test_rare_tokens_are_not_counted_by_document(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, i % 3, "L", f"2024-0{1 + i % 4}-11", " ".join(rnd.choices(words, k=60) + [f"x{rnd.randrange(4000)}" for _ in range(40)])) for i in range(300)]
    posts = spark.createDataFrame(rows, POSTS)
    targets = H.window_targets(posts)
    tfidf = H.Tfidf(posts, targets, max_df=1.0, max_features=120)
    every = H.document_terms(posts)
    want = H.vocabulary(every, F.lit(targets.count()), max_df=1.0, max_features=120)
    table = lambda df: sorted((r.term, r.df, r.total, round(r.idf, 9)) for r in df.collect())
    assert table(tfidf.vocabulary) == table(want) and want.count() == 120
    tokens = lambda df: df.where("NOT contains(term, ' ')").count()
    assert tokens(tfidf.terms) < tokens(every) / 2


def test_few_pairs_are_counted_where_single_tokens_leave_room(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, i % 3, "L", f"2024-0{1 + i % 4}-11", "often seen " * 3 + " ".join(rnd.choices(words, range(60, 0, -1), k=60))) for i in range(240)]
    posts = spark.createDataFrame(rows, POSTS)
    targets = H.window_targets(posts)
    tfidf = H.Tfidf(posts, targets, max_df=1.0, max_features=200)
    every = H.document_terms(posts)
    want = H.vocabulary(every, F.lit(targets.count()), max_df=1.0, max_features=200)
    table = lambda df: sorted((r.term, r.df, r.total, round(r.idf, 9)) for r in df.collect())
    assert table(tfidf.vocabulary) == table(want) and want.count() == 200
    pairs = lambda df: df.where("contains(term, ' ')").count()
    assert pairs(tfidf.terms) < pairs(every) / 2


def test_only_terms_that_a_vocabulary_may_hold_are_kept_by_document(spark, monkeypatch):
    from topictide.operators import term_counts as C

    monkeypatch.setattr(C, "RUN_TOKENS", 50)
    monkeypatch.setattr(C, "OUT_ROWS", 7)
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(1000)]
    rows = [(i, None if i % 9 == 0 else i % 3, "L", f"2024-0{1 + i // 3 % 8}-11", "often seen " * 3 + " ".join(rnd.choices(words, range(1000, 0, -1), k=60))
             + (" seldom heard" * 9 if i % 24 == 1 or i % 24 == 4 else "")) for i in range(240)]
    posts = spark.createDataFrame(rows, POSTS)
    targets = H.window_targets(posts).where("cluster > 0 OR cluster IS NULL")
    tfidf = H.Tfidf(posts, targets, max_df=0.6, max_features=80)
    every = H.document_terms(posts).join(targets.select("cluster", "time_window"), ["cluster", "time_window"], "left_semi")
    want = H.vocabulary(every, F.lit(targets.count()), max_df=0.6, max_features=80)
    table = lambda df: sorted((r.term, r.df, r.total, round(r.idf, 9)) for r in df.collect())
    assert table(tfidf.vocabulary) == table(want) and want.where("term = 'seldom heard'").count() == 1
    rows_of = lambda df: sorted(tuple(r) for r in df.join(want, "term", "left_semi").select("cluster", "time_window", "term", "tf").collect())
    assert rows_of(tfidf.terms) == rows_of(every)
    kept = {r.term for r in tfidf.terms.collect()}
    assert {"often", "seen", "often seen"} <= {r.term for r in every.collect()} and not {"often", "seen", "often seen"} & kept
    least = want.agg(F.min("total")).first()[0]
    totals = {r.term: r.total for r in every.groupBy("term").agg(F.sum("tf").alias("total")).collect()}
    assert min(totals[t] for t in kept) > least / 2


def test_runs_have_the_tokens_of_the_text(spark, monkeypatch):
    from topictide.operators import term_counts as C

    monkeypatch.setattr(C, "RUN_TOKENS", 3)
    monkeypatch.setattr(C, "PART_BYTES", 12)
    texts = ["It's NOT 300 \u212a or \u0130x9, caf\u00e9 \u00c5NG", None, "", "the", "one\ntwo\tTHREE three\x00four " * 5, "x" * 40 + " y\u017fz"]
    posts = spark.createDataFrame([(i, 0, "L", "2024-01-11", t) for i, t in enumerate(texts)], POSTS)
    runs = H.post_runs(posts).orderBy("at").collect()
    got = []
    for r in runs:
        words = r.vocabulary.decode().split(" ")
        got += [words[int.from_bytes(r.ids[i:i + 4], "little")] for i in range(0, len(r.ids), 4)]
    want = posts.orderBy("row_id").select(X.content_tokens(F.col("text")).alias("t")).collect()
    assert got == [t for r in want for t in r.t] and len(runs) > 3


def test_a_task_counts_the_terms_of_bounded_text(spark, monkeypatch):
    posts = spark.createDataFrame([(i, i % 2, f"alpha beta{i % 5} gamma{i % 7}") for i in range(200)], "row_id long, cluster int, text string")
    whole = {tuple(r) for r in L.cluster_term_weights(posts).select("cluster", "term", F.round("weight", 9)).collect()}
    monkeypatch.setattr(L, "TASK_CHARS", 60)
    found = L.cluster_term_weights(posts)
    assert {tuple(r) for r in found.select("cluster", "term", F.round("weight", 9)).collect()} == whole
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
