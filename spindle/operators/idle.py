"""Intervals in which every head reports no load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spindle.constants import (
    FILE_BOUNDARY_SECONDS,
    GAP_FACTOR,
    IDLE_CODE,
    IDLE_MIN_ROWS,
    IDLE_MIN_SECONDS,
)
from spindle.functions import columns as C
from spindle.operators.readings import BLOCK, complete_heads, field, present
from spindle.plans.slices import UP_TO_HERE
from spindle.session import cut

RUN = ["file_seq", "last_file_seq", "start_at", "end_at", "n_rows", "touches_start", "touches_end"]


def all_heads_idle(wide: DataFrame) -> Column:
    """True where the status of every head of the file says no load."""
    idle = F.lit(True)
    for h in complete_heads(wide.columns):
        idle = idle & (~present(wide, h) | F.coalesce(field(h, "Status") == IDLE_CODE, F.lit(False)))
    return idle


def _paused(step: Column) -> Column:
    typical = F.col("median_positive")
    return F.coalesce((typical > 0) & (step > GAP_FACTOR * typical), F.lit(False))


def _fragments(stepped: DataFrame) -> DataFrame:
    """Idle runs inside each block, cut where sampling paused."""
    same = ["block_seq", "file_seq", "file_first", "file_last", "block_rows", "median_positive"]
    rows = stepped.select(
        *BLOCK, "position", "step_in_file", *same, C.micros("timestamp").alias("_at"), all_heads_idle(stepped).alias("_idle")
    )
    here = Window.partitionBy(*BLOCK).orderBy("position")
    changes = F.coalesce(F.lag("_idle").over(here) != F.col("_idle"), F.lit(False))
    cut = changes | ((F.col("position") > 1) & _paused(F.col("step_in_file")))
    rows = rows.withColumn("_cut", cut.cast("int"))
    rows = rows.withColumn("_run", F.sum("_cut").over(here.rowsBetween(*UP_TO_HERE)))
    return (
        rows.where(F.col("_idle"))
        .groupBy(*BLOCK, "_run")
        .agg(
            F.min_by("_at", "position").alias("start_at"),
            F.max_by("_at", "position").alias("end_at"),
            F.count(F.lit(1)).alias("n_rows"),
            (F.min("position") == 1).alias("touches_start"),
            (F.max("position") == F.max("block_rows")).alias("touches_end"),
            *[F.max(c).alias(c) for c in same],
        )
        .withColumns({"_order": F.struct("block_seq", "_run"), "last_file_seq": F.col("file_seq")})
    )


def _chain(runs: DataFrame, keys: list[str], along: WindowSpec, joins: Column) -> DataFrame:
    """Merge each run with the one before it where `joins` holds."""
    starts = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    chained = runs.withColumn("_new", starts).withColumn(
        "_chain", F.sum("_new").over(along.rowsBetween(*UP_TO_HERE))
    )
    first = lambda c: F.min_by(c, "_order").alias(c)
    last = lambda c: F.max_by(c, "_order").alias(c)
    return chained.groupBy(*keys, "_chain").agg(
        *[first(c) for c in ("start_at", "touches_start")],
        *[last(c) for c in ("end_at", "touches_end")],
        F.sum("n_rows").alias("n_rows"),
        F.min("_order").alias("_order"),
        F.max("last_file_seq").alias("last_file_seq"),
        *([] if "file_seq" in keys else [F.min("file_seq").alias("file_seq")]),
    )


def _times(runs: DataFrame) -> DataFrame:
    return runs.withColumns(
        {"start_time": C.from_micros("start_at"), "end_time": C.from_micros("end_at")}
    ).withColumn("duration_seconds", (F.col("end_at") - F.col("start_at")) / 1e6)


def idle_runs_per_file(stepped: DataFrame) -> DataFrame:
    """Idle runs of each file and whether they touch its first or last row.

    Runs are found inside each block; those touching a block edge, at most two
    per block, are then joined along the file.
    """
    fragments = cut(_fragments(stepped))
    inner = fragments.where(~F.col("touches_start") & ~F.col("touches_end"))
    edge = fragments.where(F.col("touches_start") | F.col("touches_end"))
    along = Window.partitionBy("file_seq").orderBy("_order")
    step = (F.col("start_at") - F.lag("end_at").over(along)) / 1e6
    follows = (F.lag("block_seq").over(along) == F.col("block_seq") - 1) & F.lag("touches_end").over(along)
    edge = edge.withColumn("_joins", F.col("touches_start") & follows & ~_paused(step))
    # from here on "touches" refers to the file
    whole_file = {
        "touches_start": F.col("touches_start") & F.col("file_first"),
        "touches_end": F.col("touches_end") & F.col("file_last"),
    }
    merged = _chain(edge.withColumns(whole_file), ["file_seq"], along, F.col("_joins"))
    names = [*RUN, "_order"]
    return merged.select(*names).unionByName(inner.select(*names))


def merge_runs_across_files(runs: DataFrame) -> DataFrame:
    """Join a run that ends a file with one that starts the next file at most
    five seconds later. Only runs touching a file edge, at most two per file,
    take part."""
    inner = runs.where(~F.col("touches_start") & ~F.col("touches_end"))
    edge = runs.where(F.col("touches_start") | F.col("touches_end"))
    along = Window.partitionBy().orderBy("file_seq", "_order")
    step = (F.col("start_at") - F.lag("end_at").over(along)) / 1e6
    follows = (F.lag("last_file_seq").over(along) == F.col("file_seq") - 1) & F.lag("touches_end").over(along)
    near = step <= FILE_BOUNDARY_SECONDS
    merged = _chain(edge, [], along, F.col("touches_start") & follows & near)
    return merged.select(*RUN).unionByName(inner.select(*RUN))


def long_runs(runs: DataFrame) -> DataFrame:
    """Runs of at least 30 rows or 30 seconds."""
    long_enough = (F.col("n_rows") >= IDLE_MIN_ROWS) | (F.col("duration_seconds") >= IDLE_MIN_SECONDS)
    return _times(runs).where(long_enough).select("start_time", "end_time", "duration_seconds")


def idle_periods(stepped: DataFrame) -> DataFrame:
    return long_runs(merge_runs_across_files(idle_runs_per_file(stepped)))


def idle_runs_table(runs: DataFrame) -> DataFrame:
    """Runs with times instead of microseconds."""
    return _times(runs).select(
        "file_seq", "start_time", "end_time", "n_rows", "touches_start", "touches_end", "duration_seconds"
    )
