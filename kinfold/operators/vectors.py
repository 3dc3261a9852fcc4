"""Vectors of texts, kept by text and encoder, so that only new texts are encoded.

A store is a folder for each version of an encoder.  What a run adds is
published whole under a new name, so a crash leaves nothing half kept.  A text
is known by its SHA-256; texts that repeat are encoded once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import settle
from . import similarity
from .eventlog import Folder

KEPT = "key binary, vec array<double>"


class Vectors:
    def __init__(self, spark: SparkSession, root: str, version: str):
        self.home = Folder(spark, f"{root.rstrip('/')}/{version}")

    def kept(self) -> DataFrame:
        """key, vec of every text encoded so far."""
        named, spark = self.home.names(), self.home.spark
        if not named:
            return spark.createDataFrame([], KEPT)
        rows = spark.read.schema(KEPT).parquet(*[f"{self.home.path}/{n}" for n in named])
        return rows.dropDuplicates(["key"]) if len(named) > 1 else rows  # two runs at once may have encoded one text

    def encoded(self, texts: DataFrame, encode: Callable[[list[str]], np.ndarray], batch: int = similarity.ENCODE_BATCH) -> DataFrame:
        """id, vec of texts (id, text); ``encode`` gets those whose text has no vector yet.  Rows without text have none."""
        keyed = texts.filter("text IS NOT NULL").select("id", "text", F.unhex(F.sha2("text", 256)).alias("key"))
        open_ = keyed.join(self.kept().select("key"), "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))
        new = settle(open_.withColumn("id", F.monotonically_increasing_id()), "new-texts")
        if not new.isEmpty():
            aside = self.home.aside("run")
            made = similarity.encoded(new, encode, batch)
            made.join(new.select("id", "key"), "id").select("key", "vec").write.parquet(f"{self.home.path}/{aside}")
            self.home.publish(aside, f"run-{uuid.uuid4().hex}")
        return keyed.select("id", "key").join(self.kept(), "key").select("id", "vec")
