"""What a run publishes: its mapping, the audited mapping, and the log of decisions, as tables and as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import codes
from ..operators.runs import Run, family_code, family_id

#: Decisions up to which the families decided on are broadcast.
BROADCAST_DECISIONS = 100_000
_TIME = "yyyy-MM-dd HH:mm:ss'Z'"


def mapping(run: Run) -> DataFrame:
    """One row for each record, in the published columns; price, unit of measure and label stay inside."""
    number = F.col("family_no")
    return run.records().select(
        family_id(number).alias("Family_ID"), family_code(number).alias("Canonical_Code"), F.col("description").alias("Original_Description"), F.col("text").alias("Normalized_Description"),
        F.col("golden").alias("Golden_Record"), F.col("score").alias("Semantic_Similarity"), T.confidence(F.col("score")).alias("Confidence"), F.col("cpse").alias("CPSE"),
        F.col("code").alias("Original_Material_Code"), "family_no", "row_id",
    )


def audited(run: Run) -> DataFrame:
    """The mapping with each family's proposed code and what was decided on it."""
    proposed = codes.propose(run.families()).select("family_no", F.col("proposed_code").alias("Proposed_Code"))
    known = run.review_states().select(
        "family_no", F.col("state").alias("Review_State"), _stamp(F.col("at")).alias("Reviewed_At"), F.col("by").alias("Reviewed_By"),
        family_id(F.col("merged_from")).alias("Merged_From"), family_id(F.col("split_from")).alias("Split_From"),
    )
    # Families grow with the data and are left to the planner; those decided on are as many as people's decisions, which are counted.
    few = F.broadcast(known) if run.live().count() <= BROADCAST_DECISIONS else known
    whole = mapping(run).join(proposed, "family_no", "left").join(few, "family_no", "left")
    return whole.withColumn("Review_State", F.coalesce("Review_State", F.lit("unreviewed"))).fillna("", ["Proposed_Code", "Reviewed_At", "Reviewed_By", "Merged_From", "Split_From"])


def decisions(run: Run) -> DataFrame:
    """The log in its fourteen published columns, headed even when it is empty."""
    who = lambda c: F.when(F.col(c).isNull() | (F.col(c) == ""), C.UNATTRIBUTED).otherwise(F.col(c))
    said = lambda c: F.when(F.col(c), "yes").otherwise("no")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return run.log().select(
        F.col("seq").alias("Seq"), _stamp(F.col("at")).alias("Decided_At"), who("by").alias("Decided_By"), F.col("verb").alias("Action"), family_code(F.col("family_no")).alias("Canonical_Code"),
        family_id(F.col("family_no")).alias("Family_ID"), F.col("affected").alias("Affected_Records"), blank(family_code(F.col("related_no"))).alias("Related_Code"),
        blank(family_id(F.col("related_no"))).alias("Related_Family_ID"), F.col("summary").alias("Summary"), said("reversible").alias("Reversible"), said("undone").alias("Undone"),
        blank(_stamp(F.col("undone_at"))).alias("Undone_At"), F.when(F.col("undone"), who("undone_by")).otherwise("").alias("Undone_By"),
    ).orderBy("Seq")


def _stamp(at: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), _TIME)


def ordered(table: DataFrame) -> DataFrame:
    """Families by number, in each the best scores first."""
    return table.orderBy("family_no", F.desc("Semantic_Similarity"), "row_id").drop("family_no", "row_id")


def preview(run: Run, lines: int = 20) -> DataFrame:
    """The first rows of the mapping: 1 to 200."""
    return ordered(mapping(run)).limit(max(1, min(200, lines)))


def write_csv(table: DataFrame, path: str) -> None:
    """CSV with a header in each part; an empty table still writes its header."""
    table.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export(run: Run, path: str, audit: bool = False) -> None:
    """The whole mapping, sorted by family across its parts."""
    write_csv(ordered(audited(run) if audit else mapping(run)), path)
