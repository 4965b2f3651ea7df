"""Column building blocks with one missing marker, NULL: NaN and infinities are turned into it at the borders."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

def Wt():
    """All rows of a symbol in the order of its calendar."""
    return Window.partitionBy("symbol").orderBy("t")


def X():
    """The cross section of a day."""
    return Window.partitionBy("t")


def W(w: int):
    """The last ``w`` rows of a symbol's calendar, the current one included."""
    return Wt().rowsBetween(-(w - 1), 0)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def both(c: Column, *others: Column) -> Column:
    """``c`` where all others are present too."""
    ok = c.isNotNull()
    for o in others:
        ok = ok & o.isNotNull()
    return F.when(ok, c)


def gate(c: Column, n: Column, least: int) -> Column:
    return F.when(n >= least, c)


def at_least(c: Column, floor: float) -> Column:
    """max(c, floor), NULL for NULL."""
    return F.when(c < floor, F.lit(floor)).otherwise(c)


def den(c: Column, floor: float = 1e-9) -> Column:
    """A denominator kept away from zero with its sign; zero counts as positive."""
    return at_least(F.abs(c), floor) * F.when(c == 0, 1.0).otherwise(F.signum(c))


def clip(c: Column, lo: Column | float, hi: Column | float) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(c.isNull() | lo.isNull() | hi.isNull(), None).when(c < lo, lo).when(c > hi, hi).otherwise(c)


def correlation(x: Column, y: Column, over=None) -> Column:
    """Pearson over rows where both are present; NULL where a variance is zero (``corr`` would raise under ANSI rules)."""
    a, b = both(x, y), both(y, x)
    parts = [F.covar_samp(a, b), F.stddev_samp(a), F.stddev_samp(b)]
    cov, sa, sb = [p.over(over) for p in parts] if over is not None else parts
    return F.try_divide(cov, sa * sb)


def average_rank(x: Column, *by: str) -> Column:
    """Rank from 1 with ties averaged, within the groups ``by``; NULL for NULL."""
    group = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    tied = F.count(x).over(group.rangeBetween(Window.currentRow, Window.currentRow))  # the same sort; no exchange by value
    return F.when(x.isNotNull(), F.rank().over(group) + (tied - 1) / 2.0)
