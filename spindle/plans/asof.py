"""Latest-interval lookup for every event, without an interval join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.columns import micros
from spindle.plans.slices import BEFORE_HERE, SLICE, UP_TO_HERE, slice_bounds, slice_index


def latest_intervals(events: DataFrame, intervals: DataFrame) -> DataFrame:
    """Add `_open_start`, `_open_end` (the interval with the latest start <= the
    event) and `_closed_end` (the latest interval end <= the event), in
    microseconds, to every event.

    Both sides are cut by time and interleaved inside each slice; a slice also
    gets one row with what was latest before it began. An interval boundary at
    the very time of an event counts as before it.
    """
    events = events.withColumn("_at", micros("timestamp"))
    bounds = slice_bounds(events, "_at")
    events = events.withColumn(SLICE, slice_index("_at", bounds)).withColumn("_side", F.lit(1))

    start, end = micros("start_time"), micros("end_time")
    opened = intervals.select(start.alias("_at"), start.alias("_s"), end.alias("_e"))
    closed = intervals.select(end.alias("_at"), end.alias("_c"))
    marks = (
        opened.unionByName(closed, allowMissingColumns=True)
        .where(F.col("_at").isNotNull())
        .withColumn(SLICE, slice_index("_at", bounds))
    )
    per_slice = marks.groupBy(SLICE).agg(
        F.max(F.when(F.col("_s").isNotNull(), F.struct("_s", "_e"))).alias("_o"),
        F.max("_c").alias("_c"),
    )
    # one row per slice, at most MAX_SLICES of them
    all_slices = events.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias(SLICE))
    earlier = Window.partitionBy().orderBy(SLICE).rowsBetween(*BEFORE_HERE)
    carry = all_slices.join(per_slice, SLICE, "left").select(
        SLICE,
        F.last("_o", ignorenulls=True).over(earlier).alias("_o"),
        F.max("_c").over(earlier).alias("_c"),
        F.lit(-1).alias("_side"),
    )
    lookup = marks.select(
        SLICE,
        "_at",
        F.when(F.col("_s").isNotNull(), F.struct("_s", "_e")).alias("_o"),
        "_c",
        F.lit(0).alias("_side"),
    ).unionByName(carry, allowMissingColumns=True)
    mixed = events.unionByName(lookup, allowMissingColumns=True)
    # the carry row has no time and sorts first; the end breaks ties of starts
    so_far = (
        Window.partitionBy(SLICE).orderBy(F.col("_at").asc_nulls_first(), "_side", "_o").rowsBetween(*UP_TO_HERE)
    )
    return (
        mixed.withColumns(
            {
                "_latest": F.last("_o", ignorenulls=True).over(so_far),
                "_closed_end": F.max("_c").over(so_far),
            }
        )
        .where(F.col("_side") == 1)
        .withColumns({"_open_start": F.col("_latest._s"), "_open_end": F.col("_latest._e")})
        .drop("_o", "_c", "_side", "_latest", SLICE)
    )
