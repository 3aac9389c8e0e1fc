"""From raw documents to packed training sequences: a quality classifier, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. A stage works on all rows that the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm import chosenpath, cuckoo, mixing, packing
from tidepanel.llm import quality as classifier
from tidepanel.llm.store import drop, free, saved, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least THRESHOLD; the classifier learns from the labels of these documents."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = free("_quality", docs.columns)
    return classifier.with_scores(docs, classifier.learn(docs, labels), score).where(F.col(score) >= THRESHOLD).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three of them share, but in the last; none goes, even if it becomes empty."""
    small_batches(spark)
    names = docs.columns
    return cuckoo.line_dedup(docs, figures=False).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group that shingles of five words tie together at 0.8.

    Documents without an id stay. Rows that repeat an id are one document.
    """
    small_batches(spark)
    names, rank = docs.columns, free("_again", docs.columns)
    kept = chosenpath.near_duplicates(docs, k=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    again = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.length("text").asc_nulls_last())
    left = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn(rank, F.row_number().over(again)).where(F.col(rank) == 1)
    return left.select(*names).unionByName(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources draws them."""
    small_batches(spark)
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their bins."""
    small_batches(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        drop(*done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
