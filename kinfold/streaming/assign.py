"""New descriptions, as they arrive, against the families of a run.  An extension: the engine's own work is on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from ..functions import text as T
from ..operators import probes as P
from ..operators import similarity as S
from ..stage import settle


def assign(rows: DataFrame, families: DataFrame) -> DataFrame:
    """row_id, text, family_no, score, merges: the family whose golden text is nearest, ties to the smaller number.

    A text with no trigram in common with a family has no family.
    """
    texts = rows.select("row_id", T.normalize(F.col("description")).alias("text"))
    known = settle(S.trigrams(families.select(F.col("family_no").alias("id"), F.col("golden").alias("text"))), "family-grams")
    distinct = settle(texts.groupBy("text").agg(F.min("row_id").alias("id")).filter("text IS NOT NULL"), "arriving")
    best = P.nearest(settle(S.trigrams(distinct), "arriving-grams"), known, 1)
    found = distinct.join(best, "id").select("text", F.col("other").alias("family_no"), F.round("cos", 4).alias("score"), (F.col("cos") >= C.SIMILARITY_THRESHOLD).alias("merges"))
    return texts.join(found, "text", "left").select("row_id", "text", "family_no", "score", F.coalesce("merges", F.lit(False)).alias("merges"))


def start(arriving: DataFrame, families: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Assign each micro-batch and write it to ``out``, under the batch's number so that a repeated batch replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        assign(batch, families).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
