"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.store import free

HOT = 1_000  # a key of more than a thousandth of the rows is dealt to several tasks
LEAST = 1_000  # but no key of fewer rows


def dealt(rows: DataFrame, table: DataFrame, key: list[str], how: str = "inner", total: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined by ``key`` to ``table``, which has at most one row for each key.

    At most HOT keys have over a HOT-th of the rows: their list is taken to the driver, and their rows stay where they are and
    get the keys' rows of ``table``, at most HOT, by a broadcast. All others are joined as Spark sees fit; rows with a null
    in the key, which match nothing, are dealt by a hash. ``rows`` is read once more if there are hot keys. ``total`` is the
    number of rows and ``counts`` (*key, n) that of each key's; what is not given is counted.
    """
    total = rows.count() if total is None else total
    if total <= LEAST:
        return rows.join(table, key, how)
    n, salt = (free(x, [*rows.columns, *table.columns]) for x in ("_n", "_salt"))
    counts = rows.groupBy(*key).agg(F.count("*").alias(n)) if counts is None else counts.select(*key, F.col("n").alias(n))
    known = reduce(Column.__and__, (F.col(f"`{c}`").isNotNull() for c in key))
    hot = counts.where(known & (F.col(n) > max(LEAST, total // HOT))).select(*key)
    hot, schema = hot.collect(), hot.schema  # at most HOT rows

    def plain(some: DataFrame) -> DataFrame:
        if how not in ("left", "left_anti"):
            return some.join(table, key, how)
        spread = F.when(known, 0).otherwise(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(HOT)).cast("int"))
        none = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in key)), F.lit(1)).cast("int")  # 0, but no literal, which would leave the join's keys
        return some.withColumn(salt, spread).join(table.withColumn(salt, none), [*key, salt], how).drop(salt)

    if not hot:
        return plain(rows)
    keys = F.broadcast(rows.sparkSession.createDataFrame(hot, schema))
    beside = rows.join(keys, key, "left_semi").join(F.broadcast(table.join(keys, key, "left_semi")), key, how)
    return plain(rows.join(keys, key, "left_anti")).unionByName(beside)
