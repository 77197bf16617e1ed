"""Quality rules: an ordered list of threshold conjunctions, learned from labelled statistics
by sequential covering and applied as one conditional Spark expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topictide.llm.common import WordHashes, inner_windows, map_texts, mix, sample_by_label, window_hashes

BLANKS = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
CONTINUATION = bytes(range(0x80, 0xC0))
REPEAT_WORDS = 8

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
         "n_punctuation", "n_distinct_words"]
# What the rules may ask about: a name and its expression over the statistics.
FEATURES = {
    "words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "punctuation_share": "n_punctuation / word_chars",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct_words / n_words",
}


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics) of every whole text; words are runs of other than blanks.

    ``n_dup_lines`` are lines with a word that equal an earlier line; ``n_repeat_words``
    are words within 8-word windows that the text holds twice or more, the first included.
    Null and empty texts have zeros throughout; repeated rows keep a row each."""

    def make():
        hashes = WordHashes()

        def run(keys, texts):
            out = {c: [] for c in STATS}
            spoken = []
            for text in texts:
                text = text or b""
                words = text.split()
                spoken.append(words)
                squeezed = text.translate(None, BLANKS + CONTINUATION)
                lines = [line for line in text.split(b"\n") if line.strip()]
                for name, n in zip(STATS, (
                        len(words), len(squeezed), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
                        0, len(lines), len(text) - len(text.translate(None, UPPER)), len(text) - len(text.translate(None, DIGITS)),
                        len(text) - len(text.translate(None, PUNCTUATION)), len(set(words)))):
                    out[name].append(n)
            out["n_repeat_words"] = repeated_words(hashes, spoken)
            return {"doc_id": keys, **out}

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_texts(docs, id_col, text_col, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in STATS), make)
    return out.withColumnRenamed("doc_id", id_col)


def repeated_words(hashes: WordHashes, texts: list[list[bytes]], width: int = REPEAT_WORDS) -> np.ndarray:
    """For each text how many words stand in windows that it holds more than once."""
    lengths = np.array([len(w) for w in texts], np.int64)
    total = int(lengths.sum())
    if total < width:
        return np.zeros(len(texts), np.int64)
    starts = inner_windows(lengths, width)
    of = np.repeat(np.arange(len(texts)), lengths)
    flat = np.concatenate([hashes(w) for w in texts if w])
    keys = mix(window_hashes(flat, width)[starts] + of[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(total + 1, np.int64)
    edge[starts[twice]] += 1
    np.add.at(edge, starts[twice] + width, -1)
    return np.bincount(of[np.cumsum(edge)[:total] > 0], minlength=len(texts))


@dataclass(frozen=True)
class Rule:
    """Conditions (feature, is at least, threshold) that must all hold, and the verdict then."""

    conditions: tuple[tuple[str, bool, float], ...]
    keep: bool

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, least, t in self.conditions:
            column = x[:, names.index(name)]
            out &= column >= t if least else column < t
        return out

    def __str__(self) -> str:
        said = " and ".join(f"{n} {'>=' if least else '<'} {t:.6g}" for n, least, t in self.conditions)
        return f"{'keep' if self.keep else 'drop'} if {said}"


def _gain(before: tuple[int, int], p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Information gained about the p covered examples, against all that were covered."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p * (np.log2(p / (p + n)) - np.log2(before[0] / sum(before)))
    return np.where(p > 0, gain, -np.inf)


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], most: int) -> tuple:
    """Conditions added one by one, each the threshold with the largest gain."""
    covered, conditions = np.ones(len(x), bool), []
    while len(conditions) < most and (y[covered] == 0).any():
        cx, cy = x[covered], y[covered]
        before, best = (int(cy.sum()), int((1 - cy).sum())), (1e-9, None)
        for j, name in enumerate(names):
            order = np.argsort(cx[:, j], kind="stable")
            v, up = cx[order, j], np.cumsum(cy[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            below = (up[cut], cut + 1 - up[cut])
            for least, (p, n) in ((False, below), (True, (before[0] - below[0], before[1] - below[1]))):
                gain = _gain(before, p, n)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (name, least, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        covered &= Rule((best[1],), False).holds(x, names)
    return tuple(conditions)


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray, names: list[str]) -> float:
    covered = y[rule.holds(x, names)]
    return (2 * covered.sum() - len(covered)) / len(covered) if len(covered) else -1.0


def learn_rules(x: np.ndarray, keep: np.ndarray, names: list[str], max_rules: int = 20, max_conditions: int = 4,
                least_worth: float = 0.5, seed: int = 7) -> list[Rule]:
    """Sequential covering of the rows to drop. Two thirds of the rows still uncovered grow a
    rule; on the other third its last conditions are cut as long as that doesn't lower
    (right - wrong) / covered. The first rule worth less than ``least_worth`` ends the list;
    what no rule covers is kept."""
    drop, rules, rng = 1 - keep.astype(np.int64), [], np.random.default_rng(seed)
    left = np.ones(len(x), bool)
    while len(rules) < max_rules and drop[left].any():
        part = rng.random(len(x)) < 2 / 3
        grow, prune = left & part, left & ~part
        if not drop[grow].any() or not drop[prune].any():
            break
        conditions = _grow(x[grow], drop[grow], names, max_conditions)
        if not conditions:
            break
        shorter = [Rule(conditions[:k], False) for k in range(1, len(conditions) + 1)]
        best = max(shorter, key=lambda r: (_worth(r, x[prune], drop[prune], names), -len(r.conditions)))
        if _worth(best, x[prune], drop[prune], names) < least_worth:
            break
        rules.append(best)
        left &= ~best.holds(x, names)
    return rules


def decision_list(rules: list[Rule], otherwise: bool = True) -> Column:
    """The rules in order as one conditional expression over the statistics. A feature that
    has no value, as of a text without words, meets no condition."""
    out = None
    for rule in rules:
        met = F.lit(True)
        for name, least, t in rule.conditions:
            value = F.coalesce(F.expr(FEATURES[name]), F.lit(-1.0 if least else float("inf")))
            met = met & (value >= t if least else value < t)
        out = F.when(met, rule.keep) if out is None else out.when(met, rule.keep)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
          rows_per_label: int = 10_000) -> list[Rule]:
    """Rules from about ``rows_per_label`` labelled rows of each label, chosen by a hash of
    the id. Rows with a null id or label and rows that fail the base rules teach nothing; a
    label 1 outweighs other labels of the same id; without labels of both kinds there are
    no rules."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = known.where("_id is not null and _label is not null").groupBy("_id").agg(F.max("_label").alias("_label"))
    known = sample_by_label(known, "_id", "_label", rows_per_label)
    rows = (stats.where(~base_failed()).join(known, F.col(id_col) == F.col("_id"))
            .select("_label", "_id", *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()]).collect())
    if not rows:
        return []
    # The split into rows that grow and prune rules follows the order.
    rows.sort(key=lambda r: (r["_id"], r["_label"], [-2.0 if v is None else v for v in r[2:]]))
    data = np.array([[np.nan if v is None else v for v in (r[0], *r[2:])] for r in rows], float)
    return learn_rules(np.nan_to_num(data[:, 1:], nan=-1.0), data[:, 0] > 0, list(FEATURES))
