"""The compression classifier: scores, held-out accuracy, and the edges of its input."""

import random

import numpy as np
import pytest

from topictide.llm import compression


def texts(n, seed=5):
    """(doc_id, text, quality): calm sentences against shouted ones with signs."""
    r = random.Random(seed)
    words = ["".join(r.choice(["ta", "ri", "mo", "sel", "van", "ko", "ent"]) for _ in range(r.randint(1, 3))) for _ in range(400)]
    out = []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randint(20, 120))]
        good = i % 3 > 0
        out.append((i, " ".join(own) + "." if good else " ".join(w.upper() + r.choice(["!!", "***", "%%"]) for w in own), int(good)))
    return out


@pytest.fixture(scope="module")
def trained(spark):
    rows = texts(600)
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 400], "doc_id long, quality int")
    return rows, docs, labels, compression.train(docs, labels)


def test_held_out_accuracy_and_order(trained):
    rows, docs, _, model = trained
    got = {r.doc_id: r.score for r in compression.score(docs, model).collect()}
    held = [(got[i], q) for i, _, q in rows if i >= 400]
    assert np.mean([(s >= 0.5) == (q == 1) for s, q in held]) >= 0.98
    assert all(0 <= s <= 1 for s in got.values())
    assert model.good and model.bad and model.slope > 0


def test_same_model_whatever_the_order_of_rows(trained):
    _, docs, labels, model = trained
    again = compression.train(docs.repartition(7), labels.repartition(5))
    assert (again.good, again.bad) == (model.good, model.bad)
    assert again.slope == pytest.approx(model.slope) and again.intercept == pytest.approx(model.intercept)


def test_every_piece_of_a_text_counts(trained):
    rows, _, _, model = trained
    good = " ".join(t for _, t, q in rows[:200] if q)[:40_000].encode()
    bad = " ".join(t for _, t, q in rows[:200] if not q)[:40_000].encode()
    sizes = compression.Sizes(model.good, model.bad, compression.PIECE_BYTES)
    first, last, both = sizes.difference(good + bad[:4096]), sizes.difference(bad[:4096] + good), sizes.difference(good + bad)
    assert first == pytest.approx(last, abs=0.01)  # where a passage stands makes no difference
    assert sizes.difference(bad) < both < sizes.difference(good)


def test_calibration_is_increasing_and_fits():
    r = np.random.default_rng(3)
    x = r.normal(0, 0.1, 4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(20 * x + 1)))).astype(int)
    slope, intercept = compression.calibrate(x, y)
    assert slope == pytest.approx(20, rel=0.15) and intercept == pytest.approx(1, abs=0.15)
    assert compression.calibrate(x, 1 - y)[0] == 0.0  # never falls
    assert compression.calibrate(np.array([0.1, 0.2]), np.array([1, 1])) == (0.0, pytest.approx(np.log(3)))


def test_edges(spark, trained):
    rows, _, _, model = trained
    odd = spark.createDataFrame([(None, "null id", 1.0), (7, None, 2.0), (7, "", 3.0), (8, "x" * 300_000, 4.0), (9, "twice", 5.0), (9, "twice", 5.0)],
                                "doc_id long, text string, score double")
    got = [(r.doc_id, r.difference, r.score) for r in compression.score(odd, model).collect()]
    assert len(got) == 6 and all(0 <= s <= 1 for _, _, s in got)
    assert [s for i, x, s in got if i == 7] == [model.prior] * 2  # no text, no evidence
    assert len({(x, s) for i, x, s in got if i == 9}) == 1


def test_no_labels_few_labels_and_contradictions(spark, trained):
    _, docs, _, _ = trained
    none = spark.createDataFrame([], "doc_id long, quality int")
    few = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, None), (None, 0), (4, 7)], "doc_id long, quality int")
    for labels, prior in ((none, 0.5), (few, 2 / 3)):
        model = compression.train(docs, labels)
        assert model.prior == pytest.approx(prior)
        assert {round(r.score, 9) for r in compression.score(docs, model).collect()} == {round(prior, 9)}
    assert compression.score(docs.where("false"), compression.train(docs.where("false"), none)).count() == 0
