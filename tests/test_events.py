import pytest

from topictide.operators import events as E
from topictide.operators.profiles import cluster_profiles
from topictide.sources.lexicon import Lexicon


def events(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "event_id long, event_text string")


WEATHER = Lexicon((
    {"id": 1, "name": "Weather Forecasting AI", "keywords": ["weather ai", "forecast"], "synonyms": ["climate model"],
     "phrases": ["weather forecasting"]},
    {"id": 2, "name": "Gaming AI", "keywords": ["chess", "alphazero"], "synonyms": [], "phrases": []}))


def test_relevant_theme_scores(spark):
    df = E.score_events(events(spark, "New weather forecasting model improves climate prediction.", ""), WEATHER)
    got = {(r.event_id, r.theme_id): r.score for r in df.collect()}
    assert got[0, 1] > 0 and got[0, 2] == 0 and got[1, 1] == 0 and len(got) == 4


STATS = [(1, "2025-01-01", 10, 0.0, 0.0, 1.0), (1, "2025-02-01", 12, 0.2, 2.0, 1.3), (1, "2025-03-01", 15, 0.25, 3.0, 1.5),
         (2, "2025-01-01", 20, 0.0, 0.0, 2.0), (2, "2025-02-01", 17, -0.15, -2.0, 2.3), (2, "2025-03-01", 15, -0.12, -2.5, 2.5)]
STATS_SCHEMA = "cluster int, time_window string, post_count int, volume_pct_change double, volume_lead double, volume_volatility double"


def test_profiles_point_up_and_down(spark):
    p = {r.cluster: r for r in cluster_profiles(spark.createDataFrame(STATS, STATS_SCHEMA)).collect()}
    assert p[1].direction_label == "up" and p[1].direction_score > 0
    assert p[2].direction_label == "down" and p[2].direction_score < 0
    assert p[1].recent_growth_lag1 == 0.25 and p[1].recent_growth_lag4 == p[1].recent_growth_lag3 == 0.0
    assert p[1].trend_slope == pytest.approx(2.5) and p[1].avg_market_share == 0.0


def test_single_window_profile(spark):
    r = cluster_profiles(spark.createDataFrame(STATS[:1], STATS_SCHEMA)).first()
    assert r.trend_slope == 0.0 and r.n_windows == 1 and r.recent_volume_lead_lag4 == 0.0


def profiles(spark, *rows):
    return spark.createDataFrame(list(rows), "cluster int, avg_volatility double, direction_score double, direction_label string")


def test_weighted_summary_and_thresholds(spark):
    lex = Lexicon(({"id": 1, "name": "Weather", "keywords": ["weather"]}, {"id": 2, "name": "Gaming", "keywords": ["chess"]}))
    prof = profiles(spark, (1, 0.2, 0.4, "up"), (2, 0.6, -0.4, "down"))
    ev = events(spark, "weather weather weather chess", "nothing here")
    scores = E.score_events(ev, lex)
    act = E.activated_themes(scores, prof, lex, default=0.5)
    out = {r.event_id: r for r in E.estimate_direction(ev, act, prof).collect()}
    assert out[0].predicted_direction == "up" and out[0].activated_theme_count == 2
    assert out[0].predicted_direction_score == pytest.approx(0.75 * 0.4 - 0.25 * 0.4)
    assert [t.theme_id for t in out[0].activated_themes] == [1, 2] and sum(t.weight for t in out[0].activated_themes) == pytest.approx(1)
    assert out[1].predicted_direction == "flat" and out[1].predicted_volatility == pytest.approx(0.4) and out[1].activated_themes == []
    strict = E.activated_themes(scores, prof, lex, default=0.5, per_theme={"1": 99})
    assert [r.theme_id for r in strict.collect()] == [2]


def test_map_names_the_topic(spark):
    lex = Lexicon(({"id": 4, "name": "Protein Folding", "keywords": ["alphafold", "protein", "folding"]},))
    prof = profiles(spark, (33, 0.2, 0.3, "up"))
    scores = E.score_events(events(spark, "AlphaFold predicts new protein structure"), lex)
    schema = "theme_id int, cluster_id int, cluster_label string"
    mapped = E.activated_themes(scores, prof, lex, spark.createDataFrame([(4, 33, "alphafold")], schema), default=1.0)
    assert [(r.theme_id, r.mapped_cluster_id) for r in mapped.collect()] == [(4, 33)]
    assert E.activated_themes(scores, prof, lex, default=1.0).count() == 0
    assert E.activated_themes(scores, prof, lex, spark.createDataFrame([(4, None, None)], schema), default=1.0).count() == 0


def test_no_profiles_means_flat_and_zero(spark):
    lex = Lexicon(({"id": 0, "name": "Test", "keywords": ["test"]},))
    ev, none = events(spark, "test"), profiles(spark, (0, 0.1, 0.1, "up")).limit(0)
    act = E.activated_themes(E.score_events(ev, lex), none, lex, default=0.1)
    r = E.estimate_direction(ev, act, none).first()
    assert (r.predicted_direction, r.predicted_volatility) == ("flat", 0.0)


def test_relevance_replies(spark):
    good = '{"theme_relevance": [{"theme_id": 1, "relevance": 1.7}, {"theme_id": "2", "relevance": "0.5"}, {"theme_id": "x", "relevance": 1}, {"theme_id": 1, "relevance": -3}]}'
    rows = [(0, good), (1, f"```json\n{good}\n```"), (2, f"Sure:\n{good} bye"), (3, "{broken"), (4, ""), (5, None), (6, "[1, 2]")]
    got = {(r.event_id, r.theme_id): r.relevance for r in E.parse_relevance(
        spark.createDataFrame(rows, "event_id long, reply string")).collect()}
    assert got == {(i, t): v for i in range(3) for t, v in ((1, 0.0), (2, 0.5))}


def test_blend_and_rerank(spark):
    scores = spark.createDataFrame([(0, 1, 0.2), (0, 2, 4.0), (1, 1, 0.0)], "event_id long, theme_id int, score double")
    rel = spark.createDataFrame([(0, 1, 1.0), (1, 1, 1.0)], "event_id long, theme_id int, relevance double")
    got = {(r.event_id, r.theme_id): r.score for r in E.blend_relevance(scores, rel).collect()}
    assert got[0, 1] == pytest.approx(0.2 + 0.35 * 4) and got[0, 2] == 4.0 and got[1, 1] == pytest.approx(0.35)
    assert [r.theme_id for r in E.rerank_candidates(scores.where("event_id = 0"), 1).collect()] == [2]
