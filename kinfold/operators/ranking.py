"""Places of rows in an order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stage import settle

_LOCAL = (1 << 33) - 1


def ranked(rows: DataFrame, order: list[Column], place: str) -> DataFrame:
    """``rows`` with ``place``: 1, 2, ... in an order that no two rows share.

    Rows are dealt to partitions by ranges of the order and sorted there; a
    row's place is its place in its partition after all rows of the partitions
    before.  Only the partitions' sizes, one row each, meet in one task.
    """
    at = "__place"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    dealt = settle(dealt, "ranked").withColumns({"__part": F.shiftright(at, 33), at: F.col(at).bitwiseAND(F.lit(_LOCAL))})
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return dealt.join(sizes, "__part").withColumn(place, F.col("__before") + F.col(at) + 1).drop("__part", "__before", at)
