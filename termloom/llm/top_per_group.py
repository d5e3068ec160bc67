"""The N best items of every group, with a fixed order among equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def top_per_group(df: DataFrame, group: list[str], item: list[str], score: str, n: int = 10,
                  ties: list[str] | None = None) -> DataFrame:
    """Up to ``n`` rows per group with the highest ``score``, then the highest ``ties``, then the highest ``item``; adds ``rank``.

    Fully equal rows (over group, item, score and ties) count once; rows with a null score never count; null groups form a group;
    a null tie or item ranks last. Extra columns are dropped.

    The de-duplication combines map-side; the rank filter becomes a WindowGroupLimit on either side of the
    second exchange, so each task sends at most ``n`` rows per group, even where a group has millions.
    """
    order = [score, *(ties or []), *item]
    rows = df.select(*dict.fromkeys([*group, *order])).where(F.col(score).isNotNull()).distinct()
    w = Window.partitionBy(*group).orderBy(*(F.desc_nulls_last(c) for c in order))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
