"""Imputing, winsorising, and dropping columns that others explain."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import clip
from tidepanel.operators import profile
from tidepanel.operators.windows import by_ticker, filled

# Columns that are never changed or dropped, what a macro column's name holds, and what is winsorised.
TARGETS = ("Excess_5d_fwd", "Ret_5d_fwd", "Bench_Ret_5d_fwd")
MACRO_HINTS = ("Index", "CPI", "DXY", "MOVE", "USGG", "GDBR", "GSWISS", "EURR002W", "FDTR", "ECCPEMUY", "SZCPIYOY", "VSMIX", "EURCHF", "SPREAD", "YIELD")
WINSOR_PATTERNS = (r"__logdiff1$", r"__chgstd20$")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if (t in NUMERIC or t.startswith("decimal")) and c not in without]


def feature_columns(df: DataFrame, ids: Sequence[str] = ("Date", "Ticker"), targets: Sequence[str] = TARGETS) -> list[str]:
    return numeric_columns(df, [*ids, *targets])


def macro_columns(features: Sequence[str], hints: Sequence[str] = MACRO_HINTS) -> list[str]:
    return [c for c in features if any(h in c for h in hints)]


def impute(df: DataFrame, columns: Sequence[str], window: int = 5) -> DataFrame:
    """Each ticker's gaps filled forward, then the mean of the last ``window`` rows. All columns share one sort."""
    w = by_ticker("Ticker")
    first = df.withColumns({c: filled(F.col(f"`{c}`"), w) for c in columns})
    frame = w.rowsBetween(1 - window, Window.currentRow)
    return first.withColumns({c: F.avg(F.col(f"`{c}`")).over(frame) for c in columns})


def winsorise(df: DataFrame, columns: Sequence[str], sd: float = 3.0) -> DataFrame:
    """Values held within ``sd`` sample deviations of the column's mean; without spread they stay."""
    if not columns:
        return df
    moments = df.agg(*(f(F.col(f"`{c}`")).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    wide = df.crossJoin(F.broadcast(moments))
    held = lambda i, c: F.when(F.col(f"_s{i}") > 0, clip(F.col(f"`{c}`"), F.col(f"_m{i}") - sd * F.col(f"_s{i}"), F.col(f"_m{i}") + sd * F.col(f"_s{i}"))).otherwise(F.col(f"`{c}`"))
    return wide.select(*(held(columns.index(c), c).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


def winsor_columns(columns: Sequence[str], patterns: Sequence[str] = WINSOR_PATTERNS) -> list[str]:
    return [c for c in columns if any(re.search(p, c) for p in patterns)]


def explained(pairs: DataFrame, cutoff: float = 0.95) -> DataFrame:
    """(column): columns that correlate above ``cutoff`` with any before them, whether or not that one goes itself."""
    return pairs.where((F.col("pos_a") < F.col("pos_b")) & (F.abs("corr") > cutoff)).select(F.col("b").alias("column")).distinct()


def reduce_columns(df: DataFrame, columns: Sequence[str], cutoff: float = 0.95, targets: Sequence[str] = TARGETS) -> tuple[DataFrame, list[str]]:
    """``df`` without explained columns, and their names in the table's order."""
    gone = {r[0] for r in explained(profile.correlations(df, columns), cutoff).collect()} - set(targets)  # at most a row per column
    gone = [c for c in columns if c in gone]
    return df.drop(*gone), gone


def kinds(df: DataFrame) -> DataFrame:
    """(column, kind, n) by what columns hold: 'empty', 'constant', 'number', 'date' (ISO) or 'text', and the number of values; one aggregate.

    A column is of numbers, or dates, if all its values read as such.
    """
    names, figures = df.columns, []
    for i, c in enumerate(names):
        x = F.trim(F.col(f"`{c}`").cast("string"))
        found = F.count(x).alias("n"), F.count(x.try_cast("double")).alias("numbers"), F.count(x.try_cast("date")).alias("dates"), F.min(x).alias("least"), F.max(x).alias("most")
        figures.append(F.struct(*found).alias(f"c{i}"))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("f")) for i, c in enumerate(names)))
    all_ = df.agg(*figures).select(F.explode(rows).alias("r")).select("r.column", "r.f.*")
    kind = F.when(F.col("n") == 0, "empty").when(F.col("least") == F.col("most"), "constant").when(F.col("numbers") == F.col("n"), "number").when(F.col("dates") == F.col("n"), "date").otherwise("text")
    return all_.select("column", kind.alias("kind"), "n")
