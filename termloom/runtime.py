"""Session settings, scratch tables and table loading shared by all operators."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH = "/tmp/termloom-scratch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a plain ``local`` session without that setting gets a folder on this machine;
    on a cluster a missing setting is an error, as executors could not see such a folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.environ.get("TERMLOOM_SCRATCH", _LOCAL_SCRATCH)


def new_scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below the scratch root, removed when the driver's Python ends."""
    path = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(hconf).delete(p, True)
        except Exception:  # the gateway may be gone already
            pass

    atexit.register(drop)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends there.

    The files outlive the executors that wrote them, so losing an executor later costs no recomputation.
    """
    spark = df.sparkSession
    path = new_scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, label: str, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` written once and marked for broadcast only if it has at most ``max_rows`` rows; else left to a shuffled join."""
    from pyspark.sql import functions as F

    written = materialize(df, label)
    return F.broadcast(written) if written.count() <= max_rows else written
