"""Similarity edges and threshold communities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stage import settle
from .dense import dense_edges  # noqa: F401  part of this module's face
from .ranking import ranked

#: Texts given to an encoder at once.
ENCODE_BATCH = 256


def encoded(texts: DataFrame, encode: Callable[[list[str]], np.ndarray], batch: int = ENCODE_BATCH) -> DataFrame:
    """id and the unit vector of each text (id, text), from an encoder the caller gives; a zero vector stays zero."""

    def run(frames):
        for frame in frames:
            for i in range(0, len(frame), batch):
                some = frame.iloc[i : i + batch]
                vectors = np.asarray(encode(some["text"].tolist()), float)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                yield pd.DataFrame({"id": some["id"], "vec": list(vectors / np.where(norms > 0, norms, 1.0))})

    return texts.select("id", "text").mapInPandas(run, "id long, vec array<double>")


def trigrams(texts: DataFrame) -> DataFrame:
    """id, gram, n, norm2 of the padded texts (id, text)."""
    padded = F.concat(F.lit(" "), F.col("text"), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))
    counted = texts.select("id", F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("norm2", F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("id")))


def rare_prefixes(grams: DataFrame, numerator: int = 3, denominator: int = 4) -> DataFrame:
    """id, gram: of each text its rarest grams, until the rest of its vector is too short to reach the cosine alone.

    Two texts of at least that cosine share one of these: the rarest gram they
    have in common.  What of either text comes after it in the order of rarity
    has no common gram before it, so it must be long enough.
    """
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rest = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = grams.join(often, "gram").withColumn("tail", F.sum(F.col("n") * F.col("n")).over(rest))
    return tails.filter(F.lit(denominator**2) * F.col("tail") >= F.lit(numerator**2) * F.col("norm2")).select("id", "gram")


def sparse_edges(grams: DataFrame, numerator: int = 3, denominator: int = 4) -> DataFrame:
    """Pairs whose trigram cosine is at least numerator / denominator, compared in integers, each with itself and in both orders.

    Only texts that share one of their rarest grams are compared.
    """
    few = rare_prefixes(grams, numerator, denominator)  # the two sides of the join share its exchange
    pairs = few.select(F.col("id").alias("i"), "gram").join(few.select(F.col("id").alias("j"), "gram"), "gram").filter("i < j").select("i", "j").distinct()
    whole = grams.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("gram", "n"))).alias("g"), F.first("norm2").alias("q"))  # a text's own grams
    both = pairs.join(whole.select(F.col("id").alias("i"), F.col("g").alias("ga"), F.col("q").alias("qa")), "i").join(whole.select(F.col("id").alias("j"), F.col("g").alias("gb"), F.col("q").alias("qb")), "j")
    common = F.map_zip_with("ga", "gb", lambda k, a, b: F.coalesce(a * b, F.lit(0).cast("long")))
    dots = both.select("i", "j", "qa", "qb", F.aggregate(F.map_values(common), F.lit(0).cast("long"), lambda acc, x: acc + x).alias("dot"))
    near = F.lit(denominator**2) * F.col("dot") * F.col("dot") >= F.lit(numerator**2) * F.col("qa") * F.col("qb")
    found = dots.filter(near).select("i", "j", (F.col("dot") / F.sqrt((F.col("qa") * F.col("qb")).cast("double"))).alias("cos"))
    orders = F.explode(F.array(F.struct("i", "j", "cos"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "cos")))
    selves = grams.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("cos")).distinct()
    return found.select(orders.alias("e")).select("e.*").unionByName(selves)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.count(F.lit(1)).alias("deg"))


def communities(edges: DataFrame) -> DataFrame:
    """member, seed, deg: each point joins the first seed, by most neighbours then smallest id, that reaches it."""
    seeds = edges.join(degrees(edges), "i")
    return seeds.groupBy(F.col("j").alias("member")).agg(F.min_by("i", F.struct(-F.col("deg"), F.col("i"))).alias("seed"), F.max("deg").alias("deg"))


def numbered(members: DataFrame) -> DataFrame:
    """seed, deg, size, family_no: families by size, then the order of their seeds."""
    sized = members.groupBy("seed", "deg").agg(F.count(F.lit(1)).alias("size"))
    return ranked(sized, [F.desc("size"), F.desc("deg"), F.col("seed")], "family_no")


def communities_mis(edges: DataFrame) -> DataFrame:
    """member, seed, deg where seeds don't reach each other: the first maximal independent set by most neighbours, then smallest id.

    Peeling: of the points still open, those that come before all open
    neighbours are seeds; they and what they reach are closed.  Each round
    writes its table, and the rounds end when no point is open.
    """
    deg = degrees(edges)
    rank = lambda p: F.struct(-F.col(f"d{p}"), F.col(p))
    ranked = settle(edges.join(deg.withColumnRenamed("deg", "di"), "i").join(deg.select(F.col("i").alias("j"), F.col("deg").alias("dj")), "j").select("i", "j", "di", "dj"), "ranked")
    open_, seeds = ranked, None
    while not open_.isEmpty():
        first = open_.groupBy("i").agg(F.min(rank("j")).alias("best"), F.first("di").alias("di")).filter(F.col("best") == rank("i"))
        found = settle(first.select("i"), "seeds")
        seeds = found if seeds is None else seeds.union(found)
        closed = open_.join(found, "i", "left_semi").select("j").distinct()
        open_ = settle(open_.join(closed, "j", "left_anti").join(closed.withColumnRenamed("j", "i"), "i", "left_anti"), "open")
    if seeds is None:
        return edges.select(F.col("j").alias("member"), F.col("i").alias("seed"), F.lit(0).cast("long").alias("deg")).limit(0)
    reach = ranked.join(seeds, "i", "left_semi")
    return reach.groupBy(F.col("j").alias("member")).agg(F.min_by(F.struct("i", "di"), rank("i")).alias("s")).select("member", F.col("s.i").alias("seed"), F.col("s.di").alias("deg"))
