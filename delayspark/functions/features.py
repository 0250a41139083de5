"""Feature expressions of the incident table (cyclical encodings, flags,
season, ratio and delay category).  Every function returns a Column; nothing
runs Python per row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (DEFAULT_SEASON, DELAY_BINS, DELAY_LABELS, NIGHT_HOURS, PEAK_HOURS,
                      RUSH_HOURS, SEASONS)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cyclical(col, period: int) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*x/period; NULL in, NULL out."""
    angle = F.lit(2 * math.pi) * _c(col) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def in_windows(col, windows) -> Column:
    """0/1 flag: value inside any inclusive (lo, hi) window; NULL counts as 0."""
    c = _c(col)
    cond = None
    for lo, hi in windows:
        part = c.between(lo, hi)
        cond = part if cond is None else (cond | part)
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def is_weekend(day_of_week) -> Column:
    return F.when(_c(day_of_week) >= 5, F.lit(1)).otherwise(F.lit(0))


def is_rush_hour(hour) -> Column:
    return in_windows(hour, RUSH_HOURS)


def is_peak_hour(hour) -> Column:
    return in_windows(hour, PEAK_HOURS)


def is_night(hour) -> Column:
    return in_windows(hour, NIGHT_HOURS)


def season(month) -> Column:
    """Spring 3-5, Summer 6-8, Fall 9-11, anything else (NULL too) Winter."""
    m = _c(month)
    out = None
    for name, lo, hi in SEASONS:
        out = F.when(m.between(lo, hi), F.lit(name)) if out is None else out.when(m.between(lo, hi), F.lit(name))
    return out.otherwise(F.lit(DEFAULT_SEASON))


def delay_ratio(delay="Min Delay", gap="Min Gap") -> Column:
    """delay / (gap + 1); a zero denominator gives NULL (not inf)."""
    return F.try_divide(_c(delay), _c(gap) + F.lit(1.0))


def delay_category(delay="Min Delay", include_zero: bool = False) -> Column:
    """Right-closed bins (0,5] (5,15] (15,30] (30,inf).

    Zero and negative delays get NULL, as the binning is left-open; with
    ``include_zero`` a zero delay is put in the first bin.
    """
    d = _c(delay)
    lo0 = (d >= F.lit(DELAY_BINS[0])) if include_zero else (d > F.lit(DELAY_BINS[0]))
    out = F.when(lo0 & (d <= F.lit(DELAY_BINS[1])), F.lit(DELAY_LABELS[0]))
    for i in range(1, len(DELAY_LABELS)):
        out = out.when((d > F.lit(DELAY_BINS[i])) & (d <= F.lit(DELAY_BINS[i + 1])), F.lit(DELAY_LABELS[i]))
    return out
