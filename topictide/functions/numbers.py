"""Numeric column expressions with explicit null, zero and infinity rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def number_or_zero(c: Column) -> Column:
    """Numeric value of any column; unparsable, null and NaN become 0."""
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v)


def finite_or(c: Column, default) -> Column:
    """Replace null, NaN and both infinities."""
    v = c.cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(INF))
    return F.when(bad, F.lit(default).cast("double")).otherwise(v)


def relative_change(cur: Column, prev: Column) -> Column:
    """cur / prev - 1; no previous row and 0/0 give 0, n/0 gives a signed infinity."""
    return (
        F.when(prev.isNull(), F.lit(0.0))
        .when(prev != 0, cur / F.when(prev != 0, prev) - 1.0)
        .when(cur > 0, F.lit(INF))
        .when(cur < 0, F.lit(-INF))
        .otherwise(F.lit(0.0))
    )


def direction(score: Column, epsilon) -> Column:
    """up / down strictly outside the epsilon band, flat inside it or for NaN."""
    eps = epsilon if isinstance(epsilon, Column) else F.lit(float(epsilon))
    return F.when((score > eps) & ~F.isnan(score), "up").when(score < -eps, "down").otherwise("flat")


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) if cols else F.lit(0.0)


def entropy(scores: Column) -> Column:
    """Shannon entropy of an array of scores, negatives counted as 0."""
    pos = F.transform(scores, lambda v: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)))
    s = F.aggregate(pos, F.lit(0.0), lambda a, v: a + v)
    share = lambda v: v / F.when(s > 0, s)
    e = F.aggregate(pos, F.lit(0.0), lambda a, v: a - share(v) * F.ln(share(v) + F.lit(1e-12)))
    return F.when(s > 0, e).otherwise(F.lit(0.0))


def top_two(scores: Column) -> tuple[Column, Column]:
    """Largest and second largest entry; one entry counts for both."""
    ranked = F.sort_array(scores, asc=False)
    return (
        F.coalesce(F.get(ranked, F.lit(0)), F.lit(0.0)),
        F.coalesce(F.get(ranked, F.lit(1)), F.get(ranked, F.lit(0)), F.lit(0.0)),
    )
