"""Which rows may teach a model, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of training rows: at most ``most``, one for each labelled id, the ids of least hash.

    Held-out ids, null ids and null labels teach nothing. An id labelled twice has its larger label; of an id with several
    texts the one of least hash teaches, a null text only where there is no other.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # bounded by ``most``
    first = F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"), F.length("text")))
    return rows.groupBy("doc_id").agg(first.alias("text"), F.first("y").alias("y"))
