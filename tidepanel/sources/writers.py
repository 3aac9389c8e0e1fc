"""Writing tables, split artefacts and reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, in a temporary folder, on one machine only."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='tidepanel-')).rstrip('/')}/tidepanel/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Blanks around names and values are written too."""
    df.write.mode("overwrite").options(header=True, sep=sep, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_membership(assigned: DataFrame, path: str) -> None:
    """(Ticker, Date) by split and part: what positions in files were for."""
    assigned.select("Ticker", "Date", "split_id", "part").write.mode("overwrite").partitionBy("split_id", "part").parquet(path)


def split_ids(spark: SparkSession, path: str) -> list[int]:
    """The splits that a folder of :func:`write_membership` or :func:`write_scaled` has."""
    return sorted(r[0] for r in spark.read.parquet(path).select("split_id").distinct().collect())  # a row per split


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_scaled(scaled: DataFrame, stats: DataFrame, meta: DataFrame, path: str) -> None:
    """All splits at once: rows and statistics as Parquet by split, figures as JSON lines.

    Rows go to their split before writing, so a split has few files.
    """
    scaled.repartition("split_id", "part", F.pmod(F.xxhash64("Ticker"), F.lit(4))).write.mode("overwrite").partitionBy("split_id", "part").parquet(f"{path}/scaled")
    stats.repartition("split_id").write.mode("overwrite").partitionBy("split_id").parquet(f"{path}/stats")
    meta.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/meta")


def markdown_table(df: DataFrame, columns: Sequence[str], digits: int = 6) -> str:
    """All rows of a report's table as Markdown; NULL is empty."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = df.select(*columns).collect()  # a row per column or ticker, or for each pair of feature and ticker
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)])


def heatmap(cells: DataFrame, columns: Sequence[str], side: int = 14) -> str:
    """A correlation matrix (row, column, corr) of the named columns as an SVG picture: blue below 0, red above, grey for NULL."""
    corr = {(r["row"], r["column"]): r["corr"] for r in cells.select("row", "column", "corr").collect()}  # a row per pair of columns
    margin = 8 * max(map(len, columns), default=0) + 8
    size = margin + side * len(columns)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}" font-family="monospace" font-size="{side - 4}">']
    for y, a in enumerate(columns):
        name = escape(a)
        at = margin + side * y + side - 3
        out += [f'<text x="{margin - 4}" y="{at}" text-anchor="end">{name}</text>', f'<text transform="translate({at},{margin - 4}) rotate(-90)">{name}</text>']
        for x, b in enumerate(columns):
            v = corr.get((a, b))
            pale = 255 if v is None else round(255 * (1 - min(1.0, abs(v))))
            fill = "#ccc" if v is None else f"rgb(255,{pale},{pale})" if v >= 0 else f"rgb({pale},{pale},255)"
            out.append(f'<rect x="{margin + side * x}" y="{margin + side * y}" width="{side}" height="{side}" fill="{fill}"/>')
    return "\n".join([*out, "</svg>"])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text file in a folder, in any store that Spark writes."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
