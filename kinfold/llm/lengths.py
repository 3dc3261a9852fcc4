"""Token counts from an exact histogram of encoded lengths.

``histogram`` encodes each document once and keeps one row per distinct
length.  ``curve`` adds suffix sums, from which every question about a context
limit is answered without the documents: how many are longer, how many tokens
remain after truncation, which length a quantile has.

Null text counts as empty: length 0.  An empty table gives an empty curve.
Extra columns are ignored; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import prepare, settle

#: Lengths that share a bucket of the two-level suffix sums.
SPAN = 1024


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``n_tokens`` of each document."""
    prepare(docs.sparkSession)
    path = path or tokens.default_path()

    def run(batches):
        encode = tokens.encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encode.count(batch.column(0)), pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``n_tokens``, ``n_docs`` for each distinct encoded length."""
    return lengths(docs, path).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def curve(hist: DataFrame) -> DataFrame:
    """Suffix sums over a histogram, one row per distinct length L.

    ``docs_at_least`` and ``tokens_at_least`` cover documents of L tokens or
    more; ``truncated_tokens`` is what remains of the corpus at the limit L;
    ``share_at_most`` is the share of documents of L tokens or fewer.  Sums
    run inside buckets of SPAN lengths, then over bucket totals, so that no
    task sees all lengths.
    """
    hist = settle(hist, "length-histogram").withColumn("bucket", F.floor(F.col("n_tokens") / SPAN))
    mass = F.col("n_docs") * F.col("n_tokens")
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = (
        hist.groupBy("bucket")
        .agg(F.sum("n_docs").alias("d"), F.sum(mass).alias("t"))
        .select(
            "bucket",
            F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_later"),
            F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_later"),
            F.sum("d").over(every).alias("docs_total"),
            F.sum("t").over(every).alias("tokens_total"),
        )
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens"))
    at_least, tokens_at_least = F.col("docs_later") + F.sum("n_docs").over(inside), F.col("tokens_later") + F.sum(mass).over(inside)
    return (
        hist.join(buckets, "bucket")
        .withColumn("docs_at_least", at_least)
        .withColumn("tokens_at_least", tokens_at_least)
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            (F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
            ((F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")).alias("share_at_most"),
            "docs_total",
            "tokens_total",
        )
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``docs_longer``, ``truncated_tokens`` for each context limit, from a curve.

    The suffix sums at the smallest length above a limit hold for the limit;
    a limit beyond every length truncates nothing.
    """

    def above(limit: int, value: Column) -> Column:
        return F.coalesce(F.min_by(value, F.when(F.col("n_tokens") > limit, F.col("n_tokens"))), F.lit(0))

    cells = [
        F.struct(
            F.lit(int(limit)).cast("long").alias("context_limit"),
            above(limit, F.col("docs_at_least")).alias("docs_longer"),
            (F.max("tokens_total") - above(limit, F.col("tokens_at_least")) + F.lit(int(limit)) * above(limit, F.col("docs_at_least"))).alias("truncated_tokens"),
        )
        for limit in limits
    ]
    return sums.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).filter(F.col("truncated_tokens").isNotNull())


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length that at least each share of the documents does not exceed."""
    cells = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("share_at_most") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return sums.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).filter(F.col("n_tokens").isNotNull())
