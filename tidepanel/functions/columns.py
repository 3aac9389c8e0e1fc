"""Scalar functions.

A missing value is NULL, never NaN or an infinity: what has no finite value becomes NULL where it arises,
so that aggregates and windows skip it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other names of a field.
FIELD_ALIASES = {
    "ret": "return",
    "rtn": "return",
    "daily_return": "return",
    "px_return": "return",
    "pct_return": "return",
    "rendite": "return",
    "excess_return": "excess",
    "alpha": "excess",
    "adjclose": "adj_close",
    "adj._close": "adj_close",
    "schlusspreis": "close",
    "px_last": "close",
    "last": "close",
    "price": "close",
    "smi_ret": "smi_return",
    "smi_index_return": "smi_return",
}
TARGET_EPS = 1e-12


def finite(c: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL where ``b`` is 0."""
    return F.try_divide(a, b)


def to_double(c: Column) -> Column:
    """Text to a number, NULL where it is none."""
    return finite(c.try_cast("double"))


def loose_double(c: Column) -> Column:
    """A number as spreadsheets export it: spaces and commas separate thousands; blanks and #N/A are NULL."""
    t = F.trim(c)
    return F.when((t != "") & ~F.lower(t).startswith("#n/a"), finite(F.regexp_replace(t, "[ ,]", "").try_cast("double")))


def to_day(c: Column, *formats: str) -> Column:
    """The first format that fits; a time of day after an ISO date is cut off. NULL if none fits."""
    t = F.trim(c.cast("string"))
    return F.coalesce(*(F.try_to_date(F.regexp_replace(t, r"[T ].*$", ""), f) for f in formats))


def day_first(c: Column) -> Column:
    return to_day(c, "d.M.yyyy", "yyyy-M-d", "d/M/yyyy", "d-M-yyyy")


def iso_first(c: Column) -> Column:
    return to_day(c, "yyyy-M-d", "d.M.yyyy", "d/M/yyyy")


def feature_name(ticker: Column, field: Column) -> Column:
    """``<ticker>_<field>`` without the security kind at the end and without blanks, hyphens and slashes."""
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(ticker), r"\s+SE Equity$", ""), r"\s+Index$", ""), r"\s+Curncy$", "")
    return F.concat_ws("_", F.regexp_replace(short, " ", ""), F.regexp_replace(F.trim(field), "[ /-]", ""))


def macro_name(ticker: Column) -> Column:
    """A macro series' name: its kind, wherever it stands, and blanks removed."""
    return reduce(lambda c, gone: F.replace(c, F.lit(gone), F.lit("")), (" Index", " Curncy", " "), ticker)


def field_name(field: Column) -> Column:
    """Lower case, blanks to underscores, % to pct, and one name for each of its aliases."""
    x = F.replace(F.regexp_replace(F.lower(F.trim(field)), r"\s+", "_"), F.lit("%"), F.lit("pct"))
    names = F.create_map(*(F.lit(v) for pair in FIELD_ALIASES.items() for v in pair))
    return F.coalesce(F.try_element_at(names, x), x)


def ticker_part(name: Column) -> Column:
    """What stands before the bar in ``<ticker> | <field>``."""
    return F.trim(F.split_part(name, F.lit("|"), F.lit(1)))


def log_growth(c: Column, eps: float = TARGET_EPS) -> Column:
    """``ln(1 + c + eps)``, NULL where that has no value."""
    return F.when(c + eps > -1, F.log1p(c + eps))


def ln(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def clip(c: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """``c`` held between bounds; NULL stays NULL, and a NULL bound holds nothing."""
    bounded = c if low is None else F.greatest(c, low)
    bounded = bounded if high is None else F.least(bounded, high)
    return F.when(c.isNotNull(), bounded)


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def text_number(c: Column, digits: int) -> Column:
    """Fixed digits; empty for NULL."""
    return F.when(c.isNull(), "").otherwise(F.format_string(f"%.{digits}f", c))
