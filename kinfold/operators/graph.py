"""Rows for a drawing of families: the largest families, and records sampled across spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T


def masters(families: DataFrame, limit: int = C.GRAPH_FAMILIES) -> DataFrame:
    """The families with most members, ties to the smaller number."""
    return families.orderBy(F.desc("members"), "family_no").limit(limit)


def per_family(shown: int, budget: int = C.GRAPH_BUDGET) -> int:
    """Records drawn for each of ``shown`` families: 3 to 40."""
    return max(3, min(40, (budget - shown) // max(shown, 1)))


def sampled(records: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` records of each family, in turns over its spellings, the rarest first.

    In turn t each spelling with t records or more gives one, so record t of
    the spelling ranked s comes at place (t, s).  Spellings are counted before
    any window, and a spelling gives at most ``cap`` rows to it, so a family
    or a spelling of any size is no one task's group.
    """
    key = T.squeezed(F.col("description"))
    spellings = records.groupBy("family_no", key.alias("spelling")).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("score", "cpse", "row_id"), "row_id").alias("first"))
    order = (F.col("n"), F.desc("first.score"), F.col("first.row_id"))
    rarest = F.row_number().over(Window.partitionBy("family_no").orderBy(*order))
    # Only the first ``cap`` spellings can give a record.
    few = spellings.withColumn("s", rarest).filter(F.col("s") <= cap)
    turns = few.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(cap)))))
    place = F.row_number().over(Window.partitionBy("family_no").orderBy("turn", "s"))
    return turns.withColumn("place", place).filter(F.col("place") <= cap).select("family_no", "place", "spelling", "n", F.col("first.score").alias("score"), F.col("first.cpse").alias("cpse"))
