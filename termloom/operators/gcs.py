"""Golomb-coded sets: compact approximate membership without false negatives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codecs import golomb_pack, golomb_unpack
from ..runtime import materialize

#: Items of a part of the set, which one task codes.
PART_ITEMS = 500_000


def _place(item: Column, buckets: Column) -> Column:
    """A number below ``buckets`` from the first 60 bits of SHA-1."""
    return F.pmod(F.conv(F.substring(F.sha1(item.cast("binary")), 1, 15), 16, 10).cast("bigint"), buckets)


def _part(item: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(item), parts).cast("int")


def build(items: DataFrame, column: str, bits: int = 16, part_items: int = PART_ITEMS) -> DataFrame:
    """``(part, parts, n, data)``: per part the sorted places of its items, delta- and Golomb-coded; a false positive has odds 2**-bits.

    Null items are left out. There are as many parts, chosen by hash, as keep each near ``part_items``, so no task holds all items.
    """
    held = materialize(items.where(F.col(column).isNotNull()).select(F.col(column).alias("item")).distinct(), "set-items")
    parts = F.lit(max(1, -(-held.count() // part_items)))
    placed = held.withColumn("part", _part(F.col("item"), parts))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    places = placed.join(sizes, "part").select("part", parts.alias("parts"), "n", _place(F.col("item"), F.col("n") * (1 << bits)).alias("at"))

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["at"].to_numpy())
        return pd.DataFrame({"part": [pdf["part"].iat[0]], "parts": [pdf["parts"].iat[0]], "n": [len(at)], "data": [golomb_pack(np.diff(at, prepend=0), bits)]})

    return places.groupBy("part").applyInPandas(encode, "part int, parts int, n bigint, data binary")


def contains(gcs: DataFrame, items: DataFrame, column: str, bits: int = 16) -> DataFrame:
    """``items`` with ``contained``; a null item is not contained. ``bits`` as for ``build``."""
    def decode(batches):
        for pdf in batches:
            for part, parts, n, data in zip(pdf["part"], pdf["parts"], pdf["n"], pdf["data"]):
                yield pd.DataFrame({"_part": part, "_at": np.unique(np.cumsum(golomb_unpack(data, bits, int(n))))})

    gcs = materialize(gcs, "set")
    parts = gcs.agg(F.max("parts")).first()[0] or 1
    stored = gcs.mapInPandas(decode, "_part int, _at bigint").withColumn("contained", F.lit(True))
    asked = items.withColumn("_part", _part(F.col(column), F.lit(parts))).join(gcs.select(F.col("part").alias("_part"), F.col("n").alias("_n")), "_part", "left")
    asked = asked.withColumn("_at", _place(F.col(column), F.col("_n") * (1 << bits))).join(stored, ["_part", "_at"], "left")
    return asked.withColumn("contained", F.coalesce("contained", F.lit(False))).drop("_part", "_at", "_n")
