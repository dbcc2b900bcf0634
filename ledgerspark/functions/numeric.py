"""Null-safe scalar expressions. ANSI mode is on, so every division is guarded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-9
EPS = 1e-6


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps null (greatest/least alone would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def safe_ratio_null(n: Column, d: Column, digits: int = 4) -> Column:
    """n / d rounded half-even; null when a side is null or the denominator is about zero."""
    return F.when(n.isNotNull() & (F.abs(d) >= TINY), F.bround(n / d, digits))


def safe_ratio_eps(n: Column, d: Column) -> Column:
    return n / (F.abs(d) + F.lit(EPS))


def safe_ratio_clip(n: Column, d: Column) -> Column:
    """n / (d + eps) clipped to 0..10. A denominator of exactly -eps has no value."""
    return clip(F.try_divide(n, d + F.lit(EPS)), 0.0, 10.0)


def growth_rate(recent: Column, base: Column) -> Column:
    return F.when(recent.isNotNull() & (F.abs(base) >= TINY), F.bround((recent - base) / base, 4))


def safe_div(n: Column, d: Column) -> Column:
    return F.try_divide(n.cast("double"), d.cast("double"))


def pct(n: Column, d: Column, digits: int = 2) -> Column:
    """Share in percent, 0 for an empty denominator."""
    return F.round(F.coalesce(F.try_divide(n * F.lit(100.0), d.cast("double")), F.lit(0.0)), digits)


def col_or_null(df: DataFrame, *names: str, cast: str = "double") -> Column:
    """First of the names the table has, leniently cast; an all-null column when it has none."""
    for name in names:
        if name in df.columns:
            c = F.col(f"`{name}`").try_cast(cast)
            return nan_to_null(c) if cast == "double" else c
    return F.lit(None).cast(cast)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def rounded(df: DataFrame, digits: int, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
