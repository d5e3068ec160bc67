"""Incremental indexing: each micro-batch of documents becomes one index segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index


def start_indexing(documents: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Stream documents into segments ``path/lexicon/seg=N`` and ``path/docs/seg=N``; a repeated batch overwrites its own segment."""
    def segment(batch: DataFrame, n: int) -> None:
        index.doc_table(batch).write.mode("overwrite").parquet(f"{path}/docs/seg={n}")
        index.lexicon(batch).write.mode("overwrite").parquet(f"{path}/lexicon/seg={n}")

    return documents.writeStream.foreachBatch(segment).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def merged(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(docs, lexicon)`` over all segments; of a document indexed again, the latest segment counts."""
    docs, lex = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/lexicon")
    latest = docs.groupBy("doc_id").agg(F.max("seg").alias("seg"))
    return docs.join(latest, ["doc_id", "seg"], "left_semi").drop("seg"), lex.join(latest, ["doc_id", "seg"], "left_semi").drop("seg")


def windowed_captures(documents: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Captures per time window and language; rows later than ``late`` are left out of a stream's state."""
    return (documents.withWatermark("captured_at", late).groupBy(F.window("captured_at", length).alias("w"), "lang")
            .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "lang", "n"))
