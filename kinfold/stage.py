"""Cutting lineage with tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, removed when the JVM ends; on a local master a folder of our own will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="kinfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/kinfold/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
