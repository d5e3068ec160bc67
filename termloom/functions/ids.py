"""Document numbers and record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import materialize


def skip_byte_id(n: Column) -> Column:
    """The n-th number, from 1, none of whose four bytes is 9, 10 or 32: n in base 253 with its digits moved past the three."""
    def digit(power: int) -> Column:
        d = F.floor(n / F.lit(253 ** power)) % 253
        return (d + F.when(d < 9, 0).when(d < 30, 2).otherwise(3)) * F.lit(256 ** power)

    return (digit(0) + digit(1) + digit(2) + digit(3)).cast("bigint")


def id_bytes(doc_id: Column) -> Column:
    """Four bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(doc_id), 8, "0"))


def id_from_bytes(b: Column) -> Column:
    return F.conv(F.hex(b), 16, 10).cast("bigint")


def slug(uuid: Column) -> Column:
    """A UUID as 22 characters of URL-safe base64."""
    return F.substring(F.translate(F.base64(F.unhex(F.replace(uuid, F.lit("-"), F.lit("")))), "+/", "-_"), 1, 22)


def uuid_from_slug(s: Column) -> Column:
    h = F.lower(F.hex(F.unbase64(F.concat(F.translate(s, "-_", "+/"), F.lit("==")))))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))


def number_rows(df: DataFrame, order: list[str], start: int = 0, name: str = "n") -> DataFrame:
    """Consecutive numbers from ``start + 1`` in the given order, without sorting everything in one task.

    Rows are range-partitioned, sorted and written; a row's number is its place in its partition plus the sizes of the partitions before.
    Only one row per partition (its size) goes through a single task and to all others.
    """
    sorted_ = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = sorted_.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (sorted_.withColumn("_p", part).join(F.broadcast(offsets), "_p")
            .withColumn(name, place + F.col("_before") + F.lit(start + 1)).drop("_p", "_at", "_before"))
