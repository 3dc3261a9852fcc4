"""Exact medians of groups of any size.

A small group's median is Spark's own, which keeps the group's values in one
task.  A large group's two middle values are found by counting: its range is
cut into equal cells, values are counted by cell, and the cell that holds a
wanted place is cut again, until few values are left in it or it is one value.
Counts are added up before they are shuffled, so a group with most rows is no
one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stage import settle

#: Values of a group, or of what is left of its range, that one task may hold; cells of a range.
FEW, CELLS = 10_000, 1024


def medians(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``keys`` and the exact median of the finite values of each group (``name``), the mean of the middle two where their number is even.

    Nulls, NaN and infinite values are left out; a group with nothing else has no row.
    Keys may be null.
    """
    known = rows.select(*keys, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    large = sizes.filter(F.col("n") > FEW)
    if large.isEmpty():
        return known.groupBy(*keys).agg(F.median("v").alias(name))
    large = settle(large.withColumn("g", F.monotonically_increasing_id()), "large-groups")
    same = lambda a, b: _all([a[k].eqNullSafe(b[k]) for k in keys])
    small = known.join(large, same(known, large), "left_anti").groupBy(*keys).agg(F.median("v").alias(name))
    held = settle(known.join(large, same(known, large)).select("g", "v"), "large-values")
    values = _selected(held, large.select("g", "n", "lo", "hi"))
    middle = values.groupBy("g").agg((F.sum("v") / 2).alias(name))
    return small.unionByName(large.join(middle, "g").select(*keys, name))


def _all(tests: list):
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def _selected(held: DataFrame, groups: DataFrame) -> DataFrame:
    """g, v: the two middle values of each group (one value twice where their number is odd)."""
    places = F.array(F.struct(F.lit(0).alias("t"), F.floor((F.col("n") + 1) / 2).alias("p")), F.struct(F.lit(1).alias("t"), F.floor(F.col("n") / 2 + 1).alias("p")))
    wanted = groups.select("g", "n", "lo", "hi", F.explode(places).alias("w")).select("g", "n", "lo", "hi", "w.t", F.col("w.p").cast("long").alias("p"))
    found = None
    while True:
        wanted = settle(wanted, "wanted")
        even = wanted.filter("lo = hi").select("g", "t", F.col("lo").alias("v"))
        few = wanted.filter((F.col("lo") < F.col("hi")) & (F.col("n") <= FEW))
        listed = _inside(held, few).groupBy("g", "t").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.first("p").alias("p"))  # FEW values at most
        got = even.unionByName(listed.select("g", "t", F.element_at("vs", F.col("p").cast("int")).alias("v")))
        found = got if found is None else found.unionByName(got)
        many = wanted.filter((F.col("lo") < F.col("hi")) & (F.col("n") > FEW))
        if many.isEmpty():
            return found
        # The halves keep a difference of large numbers finite; that of the smallest ones may be nothing.
        share = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        cell = F.when(F.col("v") == F.col("hi"), CELLS - 1).otherwise(F.least(F.coalesce(F.floor(share * CELLS), F.lit(0)), F.lit(CELLS - 1)))
        counts = _inside(held, many).groupBy("g", "t", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("p").alias("p"))
        before = Window.partitionBy("g", "t").orderBy("cell")  # CELLS rows at most
        counted = counts.withColumn("upto", F.sum("n").over(before)).withColumn("p", F.col("p") - (F.col("upto") - F.col("n")))
        wanted = counted.filter((F.col("p") >= 1) & (F.col("p") <= F.col("n"))).select("g", "n", "lo", "hi", "t", "p")


def _inside(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """The values of each wanted range, with what is wanted there."""
    ranges = wanted.select("g", "t", "p", "lo", "hi")
    return held.join(ranges, "g").filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
