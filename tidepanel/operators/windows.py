"""Past-only windows over each ticker's rows by date, and cross-sections of a date.

A rolling statistic that is then shifted by one row is one frame that ends at the row before, so features
of one ticker share one sort. Frames are short; a ticker's rows are sorted in one task, and cross-sections
take one more exchange, by date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidepanel.functions.columns import TARGET_EPS, ln, log_growth, ratio


def by_ticker(*keys: str, date: str = "Date") -> WindowSpec:
    """Each ticker's rows by date; without keys the whole table, for series of one row per date."""
    return Window.partitionBy(*(keys or (F.lit(1),))).orderBy(F.col(date).asc_nulls_last())


def filled(c: Column, w: WindowSpec) -> Column:
    """The last value that is not NULL, up to this row."""
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def growth(filled_c: Column, w: WindowSpec) -> Column:
    """Change against the row before; give it a column that :func:`filled` made."""
    return ratio(filled_c, F.lag(filled_c).over(w)) - 1


def forward_growth(filled_c: Column, w: WindowSpec, n: int = 5, compat: bool = False) -> Column:
    """Change over the next ``n`` rows. ``compat`` gives today's price over that of then, less 1."""
    later = F.lead(filled_c, n).over(w)
    return (ratio(filled_c, later) if compat else ratio(later, filled_c)) - 1


def rolling(agg: Callable[[Column], Column], c: Column, w: WindowSpec, n: int, least: int, shifted: bool = True) -> Column:
    """``agg`` over ``n`` rows if ``least`` of them have a value; shifted, the rows end before this one."""
    frame = w.rowsBetween(-n, -1) if shifted else w.rowsBetween(1 - n, 0)
    return F.when(F.count(c).over(frame) >= least, agg(c).over(frame))


def z_before(c: Column, w: WindowSpec, n: int = 20, least: int = 10) -> Column:
    """The value of the row before against the ``n`` rows that end with it."""
    mean, sd = rolling(F.avg, c, w, n, least), rolling(F.stddev_pop, c, w, n, least)
    return ratio(F.lag(c).over(w) - mean, sd)


def log_target(own: Column, bench: Column | None, w: WindowSpec, days: int = 5, eps: float = TARGET_EPS) -> Column:
    """Compounded excess over the next ``days`` rows; NULL if one of them is missing. Without ``bench``, ``own`` is the excess."""
    daily = log_growth(own, eps) if bench is None else log_growth(own, eps) - log_growth(bench, eps)
    frame = w.rowsBetween(1, days)
    return F.when(F.count(daily).over(frame) == days, F.expm1(F.sum(daily).over(frame)))


def log_change(c: Column, w: WindowSpec) -> Column:
    return ln(c) - F.lag(ln(c)).over(w)


def share_rank(c: Column, date: str = "Date", descending: bool = False) -> Column:
    """Average rank over the date's values, as a share of their number; NULL has none."""
    order = c.desc_nulls_last() if descending else c.asc_nulls_last()
    day = Window.partitionBy(date)
    mean = F.rank().over(day.orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(date, c)) - 1) / 2
    return F.when(c.isNotNull(), ratio(mean, F.count(c).over(day)))
