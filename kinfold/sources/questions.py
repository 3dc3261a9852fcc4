"""Questions that people ask: one JSON object a line; lines that aren't JSON are left out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T

QUESTION = "id string, question string, name string, email string, created_at string"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """All questions of the files at a path."""
    return spark.read.schema(QUESTION).option("mode", "DROPMALFORMED").json(path)


def cleaned(asked: DataFrame) -> DataFrame:
    """Questions (question, name, email) as they are kept: without control characters, cut to size, too short ones left out."""
    text = T.stripped(F.col("question"))
    kept = asked.select(text.alias("question"), F.left(T.stripped(F.col("name")), F.lit(C.MAX_ASKER)).alias("name"), F.left(T.stripped(F.col("email")), F.lit(C.MAX_ADDRESS)).alias("email"))
    made = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm'+00:00'")
    kept = kept.filter(F.char_length("question") >= C.MIN_QUESTION).withColumn("question", F.left("question", F.lit(C.MAX_QUESTION)))
    key = F.left(F.sha1(F.concat_ws("|", F.lit(uuid.uuid4().hex), F.monotonically_increasing_id().cast("string")).cast("binary")), F.lit(10))
    return kept.select(key.alias("id"), "question", "name", "email", made.alias("created_at"))


def append_questions(asked: DataFrame, path: str) -> None:
    cleaned(asked).write.mode("append").json(path)


def newest(questions: DataFrame, limit: int = 8, unlocked: bool = False) -> DataFrame:
    """The last questions; addresses only where the caller may see them, else whether there is one."""
    shown = questions.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(50, limit)))
    has = (F.coalesce("email", F.lit("")) != "").alias("has_email")
    return shown.select("id", "question", "name", "created_at", has, *([F.col("email")] if unlocked else []))
