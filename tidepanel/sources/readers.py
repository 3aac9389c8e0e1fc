"""Reading exported CSV files.

What a file looks like (separator, header, byte order mark) is decided on the driver from its first line,
read through Spark, so any store that Spark reads will do. Values stay text; functions/columns.py parses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The long table's columns and another name that exports use.
LONG_COLUMNS = ("Ticker", "Field", "Date", "Value")
LONG_ALIASES = {"Wert": "Value"}


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.option("wholetext", False).text(path).limit(1).first()
    return (row[0] if row else "").lstrip("﻿")



def _csv(spark: SparkSession, path: str, sep: str, place: str | None = None) -> DataFrame:
    """All columns as text, in the header's order; a byte order mark is no part of a name.

    ``place`` adds a column that orders rows by file, the part of the file, and the row in it.
    """
    df = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).option("enforceSchema", True).csv(path)
    names = [c.lstrip("﻿") for c in df.columns]
    if place is None:
        return df.toDF(*names)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    return df.select(*(F.col(f"`{c}`") for c in df.columns), at.alias(place)).toDF(*names, place)


def read_auto(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """Semicolons, or commas if the header has no semicolon."""
    df = _csv(spark, path, ";" if ";" in first_line(spark, path) else ",")
    return df.toDF(*(c.strip() for c in df.columns)) if strip else df


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, ",")


def read_long(spark: SparkSession, path: str) -> DataFrame:
    """(Ticker, Field, Date, Value, _seq) as text, ``_seq`` in the order of the file's rows.

    Lines that are quoted as a whole are taken apart. Headers may have any case, blanks around them, and
    Wert for Value; without the names, the first four columns count.
    """
    df = _csv(spark, path, ";", "_seq")
    names = df.columns[:-1]
    if len(names) == 1:
        parts = F.split(F.col(f"`{names[0]}`"), ";")
        names = [x.strip().strip('"') for x in names[0].split(";")]
        df = df.select(*(F.get(parts, F.lit(i)).alias(f"c{i}") for i in range(len(names))), "_seq").toDF(*names, "_seq")
    titles = [LONG_ALIASES.get(c.strip().title(), c.strip().title()) for c in names]
    if not set(LONG_COLUMNS) <= set(titles):
        df, titles = df.select(*(F.col(f"`{c}`") for c in names[:4]), "_seq"), list(LONG_COLUMNS[: len(names)])
    df = df.toDF(*titles, "_seq")
    return df.select(*(F.trim(F.col(c)).alias(c) for c in LONG_COLUMNS if c in titles), "_seq")


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def date_column(df: DataFrame) -> str:
    """The first column whose name holds "date"."""
    found = [c for c in df.columns if "date" in c.lower()]
    if not found:
        raise ValueError("no date column")
    return found[0]


def price_column(df: DataFrame, names: tuple[str, ...] = ("Price", "Last Price", "PX_LAST", "Close")) -> str:
    found = [c for c in names if c in df.columns]
    if not found:
        raise ValueError("no price column")
    return found[0]


def ticker_column(df: DataFrame, names: tuple[str, ...] = ("Ticker", "Instrument", "Symbol", "RIC", "Name")) -> str:
    """A column of one of the names, in any case; else the first text column with 2 to 2000 values, NULL being one."""
    lower = {c.lower(): c for c in df.columns}
    for name in names:
        if name in df.columns or name.lower() in lower:
            return name if name in df.columns else lower[name.lower()]
    texts = [c for c, t in df.dtypes if t == "string" and c.lower() not in ("date", "datetime", "time")]
    if texts:
        counts = df.agg(*((F.countDistinct(f"`{c}`") + F.max(F.col(f"`{c}`").isNull().cast("int"))).alias(f"c{i}") for i, c in enumerate(texts))).first()
        for c, n in zip(texts, counts, strict=True):
            if n is not None and 2 <= n <= 2000:
                return c
    raise ValueError("no ticker column; name it")


def benchmark_column(df: DataFrame) -> str | None:
    return next((c for c in df.columns if c.upper().startswith("SMI") and "PX_LAST" in c.upper()), None)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
