"""The families nearest to each of many texts, exactly, without reading every common trigram's list.

A probe's cosine to a family is a sum over the grams both have.  A gram adds at
most (its count in the probe / the probe's length) times the largest share that
any family has of it.  So:

1. Each probe looks up its rarest grams in champion lists, the families that
   have most of each gram.  The exact scores of the best of these give a floor
   that its k nearest families reach.
2. Of the probe's grams, the common ones whose bounds together stay below the
   floor are left: a family that shares only those can't be among the nearest.
   The others' lists are read.
3. A family found so stays a candidate only if what it has so far and what the
   grams left out could add reach the floor.  Only then are whole texts compared.

Scores are whole numbers divided once, so bounds are loosened by a hair against
rounding and the answer doesn't depend on the order of adding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stage import settle

#: Families in a champion list, rarest grams that a probe looks up there, and candidates scored for the floor beyond the k.
CHAMPIONS, LOOKED_UP, MORE = 32, 6, 4
SLACK = 1e-9


def whole(grams: DataFrame) -> DataFrame:
    """id, g (counts by gram), q (the squared length) of each text's own grams."""
    return grams.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("gram", "n"))).alias("g"), F.first("norm2").alias("q"))


def scored(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """id, other, cos of pairs (id, other) of texts in ``left`` and ``right`` (id, g, q)."""
    both = pairs.join(left.select("id", F.col("g").alias("ga"), F.col("q").alias("qa")), "id").join(right.select(F.col("id").alias("other"), F.col("g").alias("gb"), F.col("q").alias("qb")), "other")
    common = F.map_zip_with("ga", "gb", lambda k, a, b: F.coalesce(a * b, F.lit(0).cast("long")))
    dot = F.aggregate(F.map_values(common), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return both.select("id", "other", (dot / F.sqrt((F.col("qa") * F.col("qb")).cast("double"))).alias("cos"))


def _best(rows: DataFrame, k: int, score: str) -> DataFrame:
    """The k rows of each id with the highest score, ties to the smaller other, with their place."""
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(score), "other"))
    return rows.withColumn("place", turn).filter(F.col("place") <= k)  # Spark keeps k rows a group before the shuffle


def candidates(probes: DataFrame, grams: DataFrame, k: int) -> DataFrame:
    """id, other: pairs of probes and families among which are each probe's k nearest of those that share a gram with it."""
    weight = F.col("n") / F.sqrt(F.col("norm2").cast("double"))
    lists = settle(grams.select("gram", F.col("id").alias("other"), "n", "norm2", weight.alias("w")), "gram-lists")
    often = settle(lists.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("most")), "gram-bounds")
    asked = probes.select("id", "gram", weight.alias("v")).join(often, "gram").withColumn("bound", F.col("v") * F.col("most"))
    rarest = Window.partitionBy("id").orderBy("df", "gram")  # a text's own grams
    asked = settle(asked.withColumns({"turn": F.row_number().over(rarest), "rest": F.sum("bound").over(rarest.rowsBetween(Window.currentRow, Window.unboundedFollowing))}), "probe-grams")
    # 1. A floor.
    leaders = lists.withColumn("r", F.row_number().over(Window.partitionBy("gram").orderBy(F.desc("w"), "other"))).filter(F.col("r") <= CHAMPIONS)
    met = asked.filter(F.col("turn") <= LOOKED_UP).join(leaders.select("gram", "other", "w"), "gram").groupBy("id", "other").agg(F.sum(F.col("v") * F.col("w")).alias("part"))
    tried = settle(_best(met, k + MORE, "part").select("id", "other"), "tried")
    exact = scored(tried, whole(probes), whole(grams))
    floor = _best(exact, k, "cos").filter(F.col("place") == k).select("id", F.col("cos").alias("floor"))
    # 2. The lists that must be read: those of grams from which on the bounds still reach the floor.
    needed = settle(asked.join(floor, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK), "needed-grams")
    read = needed.filter(F.col("rest") >= F.col("floor")).select("id", "gram", "v", "floor")
    left_out = needed.filter(F.col("rest") < F.col("floor")).groupBy("id").agg(F.max("rest").alias("left"))
    # 3. Who can still reach it.
    sums = read.join(lists.select("gram", "other", "w"), "gram").groupBy("id", "other").agg(F.sum(F.col("v") * F.col("w")).alias("part"), F.first("floor").alias("floor"))
    return sums.join(left_out, "id", "left").filter(F.col("part") + F.coalesce("left", F.lit(0.0)) >= F.col("floor")).select("id", "other")


def nearest(probes: DataFrame, grams: DataFrame, k: int) -> DataFrame:
    """id, other, cos, place (from 1): each probe's k nearest families, nearest first, ties to the smaller.

    ``probes`` and ``grams`` are trigrams (id, gram, n, norm2).  Families
    without a gram in common with a probe are never near it.
    """
    found = settle(candidates(probes, grams, k), "probe-candidates")
    return _best(scored(found, whole(probes), whole(grams)), k, "cos")
