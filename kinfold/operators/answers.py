"""Answers of a language model, kept by what was asked, so that nothing is asked twice.

An answer belongs to a family's fingerprint, its golden text and the ways it is
written, not to its number or run.  A store is a folder of answers, each run's
published whole under a new name; of two answers to one question the later one
stands.  Families whose question is in the store aren't asked; those with one
question are asked once.  That a question was asked and nothing was found is
kept, too; a call that failed is not.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import settle
from . import enrich
from .eventlog import Folder


class Answers:
    """The answers of one kind (``standard``, ``same``) in a folder; another version of a model or prompt is another kind."""

    def __init__(self, spark: SparkSession, root: str, kind: str, schema: str):
        self.home, self.schema = Folder(spark, f"{root.rstrip('/')}/{kind}"), schema
        self.columns = [c.split()[0] for c in schema.split(", ") if c.split()[0] not in ("family_no", "error")]

    @classmethod
    def standards(cls, spark: SparkSession, root: str, version: str = "1") -> Answers:
        return cls(spark, root, f"standard-{version}", enrich.STANDARD)

    @classmethod
    def merges(cls, spark: SparkSession, root: str, version: str = "1") -> Answers:
        return cls(spark, root, f"same-{version}", enrich.FLAG)

    def kept(self) -> DataFrame:
        """fingerprint, at, found (whether there was anything), and the answer's columns: the last answer to each question."""
        named, spark = self.home.names(), self.home.spark
        kinds = ", ".join(c for c in self.schema.split(", ") if c.split()[0] in self.columns)
        schema = f"fingerprint string, at double, found boolean, {kinds}"
        if not named:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(*[f"{self.home.path}/{n}" for n in named])
        return rows.groupBy("fingerprint").agg(F.max_by(F.struct("at", "found", *self.columns), "at").alias("a")).select("fingerprint", "a.*")

    def ask(self, families: DataFrame, question: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The answers for ``families`` (family_no, golden, ways), of which ``question`` gets those that aren't kept; rows with ``error`` for calls that failed."""
        keyed = settle(families.withColumn("fingerprint", enrich.fingerprint(F.col("golden"), F.col("ways"))), "questions")
        once = keyed.groupBy("fingerprint").agg(F.min_by(F.struct("family_no", "golden", "ways"), "family_no").alias("f")).select("fingerprint", "f.*")
        open_ = settle(once.join(self.kept().select("fingerprint"), "fingerprint", "left_anti"), "open-questions")
        failed = None
        if not open_.isEmpty():
            said = settle(question(open_.drop("fingerprint")), "answers")  # asked once, whatever reads it
            told = open_.select("fingerprint", "family_no").join(said, "family_no", "left")
            failed = told.filter("error IS NOT NULL").select("fingerprint", "error")
            new = told.filter("error IS NULL").select("fingerprint", F.lit(time.time()).alias("at"), F.col("confidence").isNotNull().alias("found"), *self.columns)
            aside = self.home.aside("run")
            new.write.parquet(f"{self.home.path}/{aside}")
            self.home.publish(aside, f"run-{uuid.uuid4().hex}")
        names = [c.split()[0] for c in self.schema.split(", ")]
        known = keyed.select("family_no", "fingerprint").join(self.kept().filter("found"), "fingerprint").withColumn("error", F.lit(None).cast("string"))
        out = known.select(*names)
        if failed is not None:
            lost = keyed.select("family_no", "fingerprint").join(failed, "fingerprint")
            kinds = dict(c.split(" ", 1) for c in self.schema.split(", "))
            out = out.unionByName(lost.select("family_no", *[F.lit(None).cast(kinds[c]).alias(c) for c in self.columns], "error").select(*names))
        return out
