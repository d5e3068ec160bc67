"""Frequency of every term, kept up to date by signed deltas.

A change of the collection is two sets of lines: those of added or changed records as they are now, and those of changed
or deleted records as they were. Each line gets a sign; per (term, record) the signs give the change in occurrences
and whether the term entered or left the record; per term these add up to one small delta row. The counts themselves
live in a table partitioned by a hash bucket of the term, and merging a delta rewrites only the buckets it touches.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import materialize, new_scratch

COUNTS = "term string, occurrences bigint, records bigint"


def signed_delta(added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """``(term, occurrences, records)`` changes from lexicon lines ``(term, doc_id, chunk_no, freq)``.

    Fully identical lines count once within ``added`` and within ``removed``. A record must be given whole: a changed one has all its
    old lines in ``removed`` and all its new ones in ``added``. Null and empty terms are dropped, a null ``doc_id`` adds
    occurrences but no record, a null ``freq`` adds a record but no occurrences. Other columns are ignored.
    """
    def lines(df: DataFrame, sign: int) -> DataFrame:
        return df.where("term IS NOT NULL AND term <> ''").select(
            "term", "doc_id", "chunk_no", "freq", F.lit(sign).alias("sign"))

    both = lines(added, 1) if removed is None else lines(added, 1).unionByName(lines(removed, -1))
    # One exchange on (term, doc_id) serves the de-duplication and the per-record step; a hot term is spread by record.
    per_record = (
        both.repartition("term", "doc_id")
        .distinct()
        .groupBy("term", "doc_id")
        .agg(F.sum(F.col("freq").cast("bigint") * F.col("sign")).alias("occurrences"),
             (F.max((F.col("sign") > 0).cast("int")) - F.max((F.col("sign") < 0).cast("int"))).alias("entered"))
    )
    return per_record.groupBy("term").agg(
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("entered"))), F.lit(0)).cast("bigint").alias("records"),
    )


def merge_counts(counts: DataFrame, delta: DataFrame) -> DataFrame:
    """Counts after ``delta``; a term that no line holds any more disappears."""
    return (
        counts.select("term", "occurrences", "records").unionByName(delta.select("term", "occurrences", "records"))
        .groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        .where("occurrences <> 0 OR records <> 0")
    )


def record_delta(added: DataFrame, removed: DataFrame | None = None) -> int:
    """Change in the number of records, those with a non-empty term; as in ``signed_delta`` each record is given whole."""
    def records(df: DataFrame) -> int:
        named = df.where("term IS NOT NULL AND term <> '' AND doc_id IS NOT NULL").select("doc_id").distinct()
        return named.agg(F.count(F.lit(1)).alias("n")).first()["n"]

    return records(added) - (records(removed) if removed is not None else 0)


class CountStore:
    """Counts on shared storage: ``path/v=N/bucket=B``. A small manifest per version names each bucket's current version, the number of
    buckets and of records.

    A merge writes new bucket files beside the old ones and adds its manifest last, so readers and a job that dies half way
    always see a complete version. The manifest has one row per bucket (``buckets`` rows at most). Large buckets are written by several tasks.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets, self.version, self.records = spark, path, buckets, 0, 0
        self.current: dict[int, int] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> "CountStore":
        """The store as of a version, the latest by default; it knows its own number of buckets."""
        manifest = spark.read.schema("bucket int, version int, buckets int, records bigint, v int").parquet(f"{path}/manifest")
        if version is None:
            version = manifest.agg(F.max("v").alias("v")).first()["v"]
        rows = manifest.where(F.col("v") == version).collect()  # at most `buckets` rows
        if not rows:
            raise ValueError(f"no version {version} in {path}")
        store = cls(spark, path, rows[0]["buckets"])
        store.version, store.records, store.current = version, rows[0]["records"], {r["bucket"]: r["version"] for r in rows}
        return store

    def _read(self, only: set[int] | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], COUNTS + ", bucket int")
        by_version: dict[int, list[int]] = {}
        for b, v in self.current.items():
            if only is None or b in only:
                by_version.setdefault(v, []).append(b)
        for v, bs in by_version.items():
            out = out.unionByName(
                self.spark.read.schema(COUNTS + ", bucket int").parquet(f"{self.path}/v={v}").where(F.col("bucket").isin(bs)))
        return out

    def counts(self) -> DataFrame:
        return self._read().drop("bucket")

    def apply(self, added: DataFrame, removed: DataFrame | None = None) -> "CountStore":
        """Merge a change of the collection, given as for ``signed_delta``; only the change and the buckets it touches are read."""
        delta = signed_delta(added, removed)
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        delta = materialize(delta, "term-delta") if self.current else delta
        touched = {r[0] for r in delta.select(bucket).distinct().collect()} if self.current else None
        after = merge_counts(self._read(touched).drop("bucket"), delta).withColumn("bucket", bucket)
        v = self.version + 1
        after.hint("rebalance", "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/v={v}")
        written = range(self.buckets) if touched is None else touched
        self.current |= {b: v for b in written}
        self.records += record_delta(added, removed)
        rows = [(b, n, self.buckets, self.records) for b, n in sorted(self.current.items())]
        self.spark.createDataFrame(rows, "bucket int, version int, buckets int, records bigint").coalesce(1).write.parquet(f"{self.path}/manifest/v={v}")
        self.version = v
        return self


def count_terms(lines: DataFrame) -> CountStore:
    """Counts of a whole collection: its lines as one delta, merged into a new partitioned store."""
    spark = lines.sparkSession
    return CountStore(spark, new_scratch(spark, "term-counts")).apply(lines)


def mark_terms(counts: DataFrame, records: int, rare_below: int = 3, common_above: str = "0.30") -> DataFrame:
    """``counts`` with ``mark``: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than that share of all ``records``, else null.

    ``rare`` wins where both hold.
    """
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(Decimal(common_above)) * F.lit(records), "common")
    return counts.withColumn("mark", mark)
