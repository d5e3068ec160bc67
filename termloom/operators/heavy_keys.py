"""Per-key totals that stay balanced when a few keys own most rows.

Grouping by key alone sends every distinct record of a hot key to one task. Here the first grouping is by
(key, record): it combines map-side in Spark's bounded, spilling hash tables, and its shuffle spreads a hot key over
all partitions by record. What is left per key and partition is one mergeable state (lines, records, weight), so the second
shuffle moves at most one row per key and map task, however large the key.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F


def per_key_totals(df: DataFrame, key: str = "term", record: str = "doc_id", weight: str = "freq") -> DataFrame:
    """``(key, lines, records, weight_sum)`` for every value of ``key``, null and empty ones included.

    * ``lines`` counts rows as stored (repeats count), ``records`` distinct non-null ``record`` values,
      ``weight_sum`` ignores null weights and is null when a key has no other.
    * An empty input gives an empty result. Other columns are ignored, whatever their names.
    """
    state = (
        df.select(F.col(key).alias("k"), F.col(record).alias("r"), F.col(weight).cast("bigint").alias("w"))
        .groupBy("k", "r")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    )
    return state.groupBy("k").agg(
        F.sum("n").alias("lines"), F.count("r").alias("records"), F.sum("w").alias("weight_sum")
    ).withColumnRenamed("k", key)


def heavy_keys(df: DataFrame, key: str = "term", record: str = "doc_id", weight: str = "freq",
               share: str = "0.01") -> DataFrame:
    """The totals of keys holding at least ``share`` of all rows of ``df``; null and empty keys count in the total only."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    totals = per_key_totals(df, key, record, weight)
    return totals.where(_named(F.col(key)) & (F.col("lines") >= F.lit(Decimal(share)) * total) & (F.col("lines") > 0))


def _named(key: Column) -> Column:
    return key.isNotNull() & (key != F.lit(""))
