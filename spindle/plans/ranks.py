"""Places of rows in a total order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.plans.slices import BEFORE_HERE
from spindle.session import cut

IN_PARTITION = 33  # bits that number the rows of a partition


def ranked(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Add the place of each row, from 1. Ranges of the order are sorted in
    parallel; only the sizes of the ranges, one row each, are added up in one
    place."""
    ranges = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", IN_PARTITION).alias("_part")
    along = Window.orderBy("_part").rowsBetween(*BEFORE_HERE)
    sizes = ranges.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << IN_PARTITION) - 1))
    placed = ranges.withColumn("_part", F.shiftright("_id", IN_PARTITION)).join(F.broadcast(before), "_part")
    return placed.withColumn(name, F.col("_before") + inside + 1).drop("_id", "_part", "_before")
