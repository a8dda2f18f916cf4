"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (any path that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    temporary one of our own where that setting is absent on one machine (tests).
    On a cluster it must be set: executors can't see each other's local folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sievewright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, label: str, batch_bytes: int | None = None) -> tuple[DataFrame, str]:
    """Cut lineage with a parquet table in the shared folder; (table, path).
    The files outlive any executor, so a lost one only repeats its own tasks.
    ``batch_bytes`` bounds the Arrow batches (but for a single row) while it writes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    try:
        if batch_bytes:
            spark.conf.set(BATCH, batch_bytes)
        df.write.parquet(path)
    finally:
        if batch_bytes:
            spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ``written`` that no returned plan reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for a row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
