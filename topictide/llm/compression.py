"""A quality classifier by compression: zstandard dictionaries built from good and from bad
texts compress a text unequally, and the normalised difference of the two sizes, calibrated
on texts that built neither, is the score."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.llm.common import map_texts, sample_by_label
from topictide.runtime import materialize

PIECE_BYTES = 1024  # a text is compressed piece by piece, so that a dictionary counts as much at its end as at its start
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
LEAST_SAMPLES = 8  # fewer don't make a dictionary


@dataclass
class Model:
    """Two dictionaries, and slope and intercept that turn a difference into log-odds."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float
    prior: float

    def probability(self, x: float | None) -> float:
        if x is None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.slope * x + self.intercept, -30, 30))))


class Sizes:
    """How much less a text takes with the good dictionary than with the bad one."""

    def __init__(self, good: bytes, bad: bytes, piece_bytes: int):
        self.piece_bytes, self.compressors = piece_bytes, []
        for content in (good, bad):
            known = zstandard.ZstdCompressionDict(content) if content else None
            if known is not None:
                known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False,
                                                             write_dict_id=False))

    def difference(self, text: bytes | None) -> float | None:
        """(bad - good) / (bad + good), -1 to 1; null without a text."""
        if not text:
            return None
        good = bad = 0
        by_good, by_bad = (c.compress for c in self.compressors)
        for i in range(0, len(text), self.piece_bytes):
            piece = text[i:i + self.piece_bytes]
            good += len(by_good(piece))
            bad += len(by_bad(piece))
        return (bad - good) / (bad + good)


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary of at most ``size`` bytes; empty where the samples are too few
    or too short for one."""
    if len(samples) < LEAST_SAMPLES:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(sum(map(len, samples)) // 2, 256)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through (difference, label), by Newton's
    method; the labels are drawn in a little, so that separable ones have a finite slope.
    The slope is not below 0: a better fit to good texts never lowers the score."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    if not n1 or not n0:
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(float(x.std()), 1e-6)
    z = np.column_stack([(x - x.mean()) / spread, np.ones(len(x))])
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(w):
        g = z @ w
        return float((np.logaddexp(0, g) - target * g).sum() + 0.5e-3 * w[0] ** 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - target) + np.array([1e-3 * w[0], 0])
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag([1e-3, 0])
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-8:
            break
    if w[0] < 0:
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    return float(w[0] / spread), float(w[1] - w[0] * x.mean() / spread)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          rows_per_label: int = 4_000, piece_bytes: int = PIECE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """A model from about ``rows_per_label`` labelled texts of each label (1 good, 0 bad),
    chosen by a hash of the id. Of two thirds of them one piece each, also chosen by a hash,
    goes into the dictionary of its label; the whole texts of the others calibrate the
    score. So at most that many pieces and differences reach the driver.

    Null labels and labels of null ids are none; ids with both labels count for neither.
    The prior is the share of label 1 among all labelled ids; without any it is 0.5. Without
    enough texts for a dictionary every text gets about the prior."""
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
             .where("_id is not null and _label in (0, 1)")
             .groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where("_label = _most"))
    totals = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    prior = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    chosen = F.broadcast(sample_by_label(known.select("_id", "_label"), "_id", "_label", rows_per_label))  # bounded by the parameter
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    rows = materialize(texts.where(F.octet_length("_text") > 0).join(chosen, "_id")
                       .select("_label", F.pmod(F.xxhash64(F.lit(23), "_id"), F.lit(3)).alias("_part"),
                               F.pmod(F.xxhash64(F.lit(29), "_id"), F.ceil(F.octet_length("_text") / piece_bytes)).alias("_piece"), "_text"))
    pieces = (rows.where("_part > 0")
              .select("_label", F.substring("_text", F.lit(1) + F.col("_piece") * piece_bytes, F.lit(piece_bytes)).alias("_text")).collect())
    # Sorted: a trained dictionary depends on the order of its samples.
    good, bad = (build_dictionary(sorted(bytes(r["_text"]) for r in pieces if r["_label"] == k), dictionary_bytes) for k in (1, 0))
    if not good or not bad:
        return Model(b"", b"", 0.0, float(np.log(prior / (1 - prior))), prior)
    seen = differences(rows.where("_part = 0"), "_label", "_text", good, bad, piece_bytes).collect()
    x, y = np.array([r["x"] for r in seen], float), np.array([r["_label"] for r in seen])
    order = np.lexsort((y, x))
    slope, intercept = calibrate(x[order], y[order])
    # Both labels are sampled alike; the odds are taken back to those of all labels.
    seen_1, seen_0 = int((y == 1).sum()), int((y == 0).sum())
    intercept += float(np.log(prior / (1 - prior)) - np.log((seen_1 + 1) / (seen_0 + 1)))
    return Model(good, bad, slope, intercept, prior)


def differences(docs: DataFrame, key: str, text_col: str, good: bytes, bad: bytes, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(key, x): the difference of sizes of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((good, bad))

    def make():
        sizes = Sizes(*sent.value, piece_bytes)
        return lambda keys, texts: {"key": keys, "x": [sizes.difference(t) for t in texts]}

    kind = docs.schema[key].dataType.simpleString()
    return map_texts(docs, key, text_col, f"key {kind}, x double", make).withColumnRenamed("key", key)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(id, difference, score) of every whole text, the score from 0 to 1. Null and empty
    texts have no difference and get the prior; repeated rows keep a row each."""
    x, odds = F.col("x"), F.lit(model.slope) * F.col("x") + F.lit(model.intercept)
    rated = F.when(x.isNull(), F.lit(model.prior)).otherwise(1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds)))))
    found = differences(docs, id_col, text_col, model.good, model.bad, piece_bytes)
    return found.select(id_col, x.alias("difference"), rated.alias("score"))
