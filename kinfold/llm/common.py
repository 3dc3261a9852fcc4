"""Shared folder, table reading and small column helpers for the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch.  Documents can be long; a batch must fit beside the heap.
ARROW_ROWS = 400

#: Bytes of its files that a shuffled partition of texts may come from, and the most partitions asked for on that ground.
PARTITION_BYTES, MOST_PARTITIONS = 64 << 20, 2_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for this session, unless it is bounded lower."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; on a local master one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="kinfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/kinfold/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_of(df: DataFrame, each: int = PARTITION_BYTES) -> int | None:
    """How many partitions of ``each`` bytes hold what ``df`` reads, by Spark's estimate; None if the session's setting is enough."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = -(-size // each)
    return wanted if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) < wanted <= MOST_PARTITIONS else None


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` is the same and faster where every character is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; null ids give null."""
    return F.crc32(doc_id.cast("string")) % F.lit(parts)
