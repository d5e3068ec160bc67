"""Ranking formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

K1 = 1.2
B = 0.75
#: Impact scores run from 0 to this, exclusive.
IMPACT_STEPS = 16384


def idf(n_docs: Column, df: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5)): negative for terms in more than half of all documents."""
    return F.log((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def length_norm(length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return F.lit(k1 * (1 - b)) + length * F.lit(k1 * b) / avgdl


def bm25(idf_: Column, tf: Column, norm: Column, k1: float = K1) -> Column:
    return idf_ * F.lit(k1 + 1) * tf / (norm + tf)


def impact(tf: Column, norm: Column) -> Column:
    """The part of the weight that doesn't depend on the collection's term counts, as an integer."""
    return F.floor(tf / (tf + norm) * F.lit(IMPACT_STEPS)).cast("int")
