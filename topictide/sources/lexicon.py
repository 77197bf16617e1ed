"""Theme lexicon: a small hand-curated configuration, read once by the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topictide.functions.text import DOCUMENT_STOP_WORDS, EVENT_STOP_WORDS, normalized
from topictide.runtime import BROADCAST_ROW_LIMIT

TERM_FIELDS = ("keywords", "synonyms", "phrases")


@dataclass(frozen=True)
class Lexicon:
    """``themes``: dicts with id, name, description, keywords, synonyms, phrases."""

    themes: tuple[dict, ...]

    def __post_init__(self):
        if not self.themes:
            raise ValueError("No themes found in lexicon")
        if any(t.get("id") is None for t in self.themes):
            raise ValueError("Each theme must have an 'id'")
        if sum(len(self._raw(t)) for t in self.themes) > BROADCAST_ROW_LIMIT:
            raise ValueError("Lexicon too large for a configuration table")

    @staticmethod
    def _raw(theme: dict) -> list[str]:
        terms = [t for f in TERM_FIELDS for t in (theme.get(f) or [])]
        return terms or [theme.get("name", "")]

    @property
    def ids(self) -> list[int]:
        return [int(t["id"]) for t in self.themes]

    def ids_array(self) -> Column:
        return F.array(*[F.lit(i) for i in self.ids])

    def names(self, spark: SparkSession) -> DataFrame:
        """(theme_id, theme_name, theme_order) in file order."""
        rows = [(int(t["id"]), t.get("name", str(t["id"])), i) for i, t in enumerate(self.themes)]
        return spark.createDataFrame(rows, "theme_id int, theme_name string, theme_order int")

    def terms(self, spark: SparkSession, stop_words=DOCUMENT_STOP_WORDS) -> DataFrame:
        """Distinct normalised (theme_id, term)."""
        rows = [(int(t["id"]), term) for t in self.themes for term in self._raw(t)]
        raw = spark.createDataFrame(rows, "theme_id int, raw string")
        terms = raw.select("theme_id", normalized(F.col("raw"), stop_words).alias("term"))
        return terms.where(F.col("term") != "").distinct()

    def tokens(self, spark: SparkSession, stop_words=EVENT_STOP_WORDS) -> DataFrame:
        """(theme_id, token, idf): idf falls with the number of themes using the token."""
        n = max(len(self.themes), 1)
        pairs = self.terms(spark, stop_words).select(
            "theme_id", F.explode(F.split("term", " ")).alias("token")).distinct()
        df = pairs.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        return pairs.join(F.broadcast(df), "token").select(
            "theme_id", "token", (F.ln(F.lit(1.0 + n) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def load_lexicon(path: str) -> Lexicon:
    """YAML or JSON file with a top-level ``themes`` list."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            data = json.load(f)
        else:
            import yaml

            data = yaml.safe_load(f)
    return Lexicon(tuple((data or {}).get("themes") or ()))
