import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from topictide.operators import evaluation as V
from topictide.operators import features as X
from topictide.operators.profiles import cluster_profiles
from topictide.plans import training
from topictide.plans.forecast import trained_forecast
from topictide.sources.lexicon import Lexicon


@pytest.fixture(scope="module")
def stats(spark):
    rnd, rows = random.Random(5), []
    for c in range(4):
        prev = 20
        for m in range(20):
            n = max(1, prev + rnd.choice([-8, -3, 0, 0, 4, 9]))
            when = dt.date(2023 + m // 12, m % 12 + 1, 28)
            rows.append((c, when, n, n / prev - 1, rnd.random(), n - prev + 0.0, 0.25))
            prev = n
    return spark.createDataFrame(rows, "cluster int, time_window date, post_count int, volume_pct_change double, "
                                       "volume_volatility double, volume_lead double, market_share double")


def test_feature_edges(spark):
    rows = [(0, dt.date(2024, m, 28), n, g, 1.0 * m) for m, (n, g) in enumerate([(5, 0.0), (0, -1.0), (4, float("inf")), (4, 0.0)], 1)]
    base = spark.createDataFrame(rows, "cluster int, time_window date, post_count int, volume_pct_change double, volume_lead double")
    out = X.feature_frame(base).orderBy("time_window").collect()
    assert [r.next_volume_pct_change for r in out] == [-1.0, None, 0.0, None]
    assert out[3].volume_pct_change_lag1 == 0.0 and out[0].trend_slope_4 == 0.0 and out[1].trend_slope_4 == pytest.approx(-5)
    assert out[3].volume_acceleration == 0.0  # infinite, sanitised
    assert out[0].theme_entropy == 0.0 and out[0].market_share == 0.0
    assert [r.target for r in X.with_target(X.feature_frame(base), 0.05).orderBy("time_window").collect()] == ["down", "flat"]


def test_one_theme_counts_for_both_tops(spark):
    df = spark.createDataFrame([(0, dt.date(2024, 1, 31), 0.4)], "cluster int, time_window date, theme_3_score double")
    r = X.theme_features(df).first()
    assert r.theme_top1_score == r.theme_top2_score == 0.4 and r.theme_active_count == 1 and abs(r.theme_entropy) < 1e-9


def test_folds_keep_their_gap(spark, stats):
    frame = X.with_target(X.feature_frame(stats), 0.05)
    for folds in (V.walk_forward_folds(frame, 3, 6, 1), V.stacking_folds(frame)):
        by_fold = {}
        for r in folds.collect():
            by_fold.setdefault(r.fold, {"train": set(), "test": set()})[r.role].add(r.time_window)
        times = sorted(r.time_window for r in frame.select("time_window").distinct().collect())
        tests = [t for f in by_fold.values() for t in f["test"]]
        assert by_fold and len(tests) == len(set(tests))
        for f in by_fold.values():
            assert times.index(min(f["test"])) - times.index(max(f["train"])) == 2
    assert V.walk_forward_folds(frame, 3, 99, 1).count() == 0


def test_probability_rules(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.0, 0.0, 0.0), (0.1, 0.2, 0.7)], "p_down double, p_flat double, p_up double")
    out = V.adjusted_probabilities(df, {"flat": 1.1}).withColumn("prediction", V.picked_label()).withColumn("c", V.confidence()).collect()
    assert [r.prediction for r in out] == ["flat", "down", "up"]
    assert sum(out[0][p] for p in V.PROBS) == pytest.approx(1) and out[1].c == 0.0
    assert df.withColumn("prediction", V.picked_label()).first().prediction == "down"


def test_metrics_with_an_absent_class(spark):
    rows = [("a", "up", "up"), ("a", "up", "down"), ("a", "down", "down")]
    m = V.evaluate(spark.createDataFrame(rows, "model string, target string, prediction string"), ["model"]).first()
    assert m.accuracy == pytest.approx(2 / 3) and m.f1_flat == 0.0 and m.recall_up == 0.5 and m.precision_down == 0.5
    assert m.macro_f1 == pytest.approx((2 / 3 + 0 + 2 / 3) / 3) and m.cm_up_down == 1


def test_verdicts(spark):
    rows = [("logistic", 0.9, 0.7, 0.5), ("random_forest", 0.80, 0.71, None), ("soft_voting_ensemble", None, 0.7, 0.55),
            ("stacking_ensemble", None, 0.7, None)]
    got = {r.model: (r.verdict, r.temporal_stability) for r in V.overfit_verdict(spark.createDataFrame(
        rows, "model string, train_f1 double, test_f1 double, cv_f1 double")).collect()}
    assert got == {"logistic": ("likely_overfitting", "unstable"), "random_forest": ("mild_overfitting", None),
                   "soft_voting_ensemble": ("ensemble_unstable_vs_cv", "unstable"), "stacking_ensemble": ("ensemble_no_cv_compare", None)}


def test_pruning_rules(spark):
    def kept(*values):
        rows = [(f, v, i) for i, (f, v) in enumerate(zip("abcde", values))]
        df = spark.createDataFrame(rows, "feature string, importance double, position int")
        return [r.feature for r in V.with_kept(df).where("kept").orderBy("position").collect()]

    assert kept(0.1, 0.5, 0.0, 0.2) == ["a", "b", "d"] and kept(1.0) == ["a"] and kept(0.0, 0.0) == ["b"] and kept() == []
    pairs = spark.createDataFrame([(0.5, 0.49), (0.5, 0.5), (0.5, 0.45)], "full_f1 double, pruned_f1 double")
    assert [r.accepted for r in V.pruning_outcome(pairs, True, 0.02).collect()] == [True, True, False]
    assert [r.accepted for r in V.pruning_outcome(pairs).collect()] == [False, True, False]


@pytest.mark.parametrize("name", ["logistic", "random_forest", "gradient_boosting"])
def test_members_give_probabilities(spark, stats, name):
    s = training.Settings(trees=5, boosting_rounds=2)
    frame = X.with_target(X.feature_frame(stats), 0.05)
    feats = X.feature_columns(frame)
    member = training.fit_member(frame, feats, name, s, calibrate=name == "logistic")
    out = member.predict(frame).collect()
    assert all(sum(r[p] for p in V.PROBS) == pytest.approx(1) and min(r[p] for p in V.PROBS) >= 0 for r in out)
    assert training.importances(member, spark).count() == len(feats)


def test_class_never_seen_gets_zero(spark, stats):
    frame = X.with_target(X.feature_frame(stats), 0.05).where("target <> 'up'")
    member = training.fit_member(frame, X.feature_columns(frame), "random_forest", training.Settings(trees=3), calibrate=False)
    assert all(r.p_up == 0.0 for r in member.predict(frame).collect())


def test_train_save_load_forecast(spark, stats, tmp_path):
    s = training.Settings(models=("logistic", "random_forest"), epsilons=(0.05,), splits=1, trees=5, calibrate=False)
    bundle = training.train_direction_model(stats, None, s)
    assert {"models", "comparison", "overfitting", "walk_forward"} <= set(bundle.metrics)
    training.save_bundle(bundle, str(tmp_path / "model"), spark)
    again = training.load_bundle(str(tmp_path / "model"), spark)
    frame = X.with_target(X.feature_frame(stats), bundle.epsilon)
    key = ["cluster", "time_window"]
    same = bundle.predict(frame).select(*key, F.col("prediction").alias("a")).join(
        again.predict(frame).select(*key, F.col("prediction").alias("b")), key)
    assert same.where("a <> b").count() == 0 and training.model_metrics(str(tmp_path / "model"), spark).count() >= 3
    lex = Lexicon(({"id": 1, "name": "One", "keywords": ["thor"]},))
    ev = spark.createDataFrame([(0, "thor thor"), (1, "none")], "event_id long, event_text string")
    out = trained_forecast(ev, lex, cluster_profiles(stats), stats, again, default=0.5).collect()
    assert len(out) == 2 and {r.method for r in out} == {"trained"}
    assert all(r.predicted_direction in V.DIRECTIONS and sum(r.class_probabilities.values()) == pytest.approx(1) for r in out)


def test_a_trained_forecast_scores_the_themes_once(spark, tmp_path, monkeypatch):
    from catalog import model as C
    from catalog import themes

    docs = [(i, "the model of protein folding and policy " * 2, "en", "src1") for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    built, seen = [], {}
    tfidf = themes.H.Tfidf
    monkeypatch.setattr(themes.H, "Tfidf", lambda *a, **k: built.append(1) or tfidf(*a, **k))
    monkeypatch.setattr(C, "event_texts", lambda *a: None)
    monkeypatch.setattr(C.training, "train_direction_model", lambda stats, wide, settings: seen.update(wide=wide.count()))

    def forecast(events, lexicon, profiles, stats, model, mapping, per_theme):
        seen["themes"] = mapping.count()
        return spark.range(0).selectExpr("id AS event_id", *(f"'' AS {c}" for c in ("predicted_direction", "method", "confidence", "risk_band", "model_name")))

    monkeypatch.setattr(C.forecast, "trained_forecast", forecast)
    C._trained(spark, str(tmp_path))
    assert len(built) == 1 and seen["themes"] == len(C.LEXICON.ids) and seen["wide"] > 0
