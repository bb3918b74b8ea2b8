"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset, a temporary folder in local mode (tests), an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="mosslight-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh shared path, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p, fs = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and it outlives lost executors.

    While it is written, Arrow batches hold BATCH_ROWS rows at most: texts are long, and the executor and
    its Python worker both hold a batch. The session's setting is put back after that.
    """
    spark = df.sparkSession
    path, rows = new_path(spark, name), spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, str(min(int(rows), BATCH_ROWS)) if int(rows) > 0 else str(BATCH_ROWS))
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(BATCH_KEY, rows)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Remove a table made by written() that no later result reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        p, fs = _fs(df.sparkSession, path)
        fs.delete(p, True)
