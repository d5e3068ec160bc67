"""Text forms of the lexicon, the document table and the file ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """Lines ``term TAB doc_id SPACE tf``, each file sorted bytewise by (term, doc_id)."""
    (lexicon.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
     .select(F.concat_ws("\t", "term", F.concat_ws(" ", "doc_id", "tf")).alias("value")).write.text(path))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Terms never hold a tab; lines of another form give nulls, see ``invalid_lines``."""
    value = F.split("value", "\t", 2)
    pair = F.split(F.try_element_at(value, F.lit(2)), " ", 2)
    return spark.read.text(path).select(
        F.try_element_at(value, F.lit(1)).alias("term"), F.try_element_at(pair, F.lit(1)).try_cast("bigint").alias("doc_id"),
        F.try_element_at(pair, F.lit(2)).try_cast("int").alias("tf"))


def invalid_lines(lexicon: DataFrame) -> DataFrame:
    """Rows whose term is missing, empty or not valid UTF-8, or whose numbers are missing."""
    return lexicon.where("term IS NULL OR term = '' OR NOT is_valid_utf8(term) OR doc_id IS NULL OR tf IS NULL")


def write_ranges(ranges: DataFrame, path: str, mode: str = "append") -> None:
    ranges.select("start_id", "end_id", "file").write.mode(mode).option("sep", "\t").csv(path)


def read_ranges(spark: SparkSession, path: str, compressed: bool = False) -> DataFrame:
    """The range table; unless ``compressed``, a trailing ``.gz`` is taken off the file names."""
    df = spark.read.schema("start_id bigint, end_id bigint, file string").option("sep", "\t").csv(path)
    return df if compressed else df.withColumn("file", text.strip_gz(F.col("file")))


def write_url_table(docs: DataFrame, path: str) -> None:
    docs.select("doc_id", "url").write.mode("append").option("sep", "\t").csv(path)
