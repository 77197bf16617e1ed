"""Calendar windows labelled by DATE, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted window names.
MONTH, WEEK, DAY, QUARTER = "1M", "1W", "1D", "3M"
_ALIASES = {"1M": MONTH, "1ME": MONTH, "M": MONTH, "ME": MONTH,
            "1W": WEEK, "W": WEEK, "1D": DAY, "D": DAY, "3M": QUARTER, "3ME": QUARTER}


def window_name(freq: str) -> str:
    try:
        return _ALIASES[freq]
    except KeyError:
        raise ValueError(f"Unsupported window: {freq}") from None


def window_label(ts: Column, freq: str, anchor: Column | None = None) -> Column:
    """Date that names the window holding ``ts``: month end, the Sunday on or
    after, the day, or for 3M the end of a three-month bin whose first bin ends
    with the month of ``anchor``."""
    freq = window_name(freq)
    day = ts.cast("date")
    if freq == MONTH:
        return F.last_day(day)
    if freq == WEEK:
        return F.next_day(F.date_sub(day, 1), "SU")
    if freq == DAY:
        return day
    if anchor is None:
        raise ValueError("3M windows need an anchor date")
    base = F.trunc(anchor.cast("date"), "MM")
    months = (F.year(day) - F.year(base)) * 12 + F.month(day) - F.month(base)
    return F.last_day(F.add_months(base, (F.ceil(months / F.lit(3.0)) * 3).cast("int")))


def windows_until(start: Column, stop: Column, freq: str) -> Column:
    """Labels from ``start`` up to, not including, ``stop`` (null: only start)."""
    freq = window_name(freq)
    if freq in (MONTH, QUARTER):
        step = 1 if freq == MONTH else 3
        lo, hi = F.trunc(start, "MM"), F.add_months(F.trunc(stop, "MM"), -step)
        every = F.expr(f"INTERVAL {step} MONTH")
        return F.transform(F.sequence(lo, F.coalesce(hi, lo), every), lambda d: F.last_day(d))
    step = 7 if freq == WEEK else 1
    return F.sequence(start, F.coalesce(F.date_sub(stop, step), start), F.expr(f"INTERVAL {step} DAY"))
