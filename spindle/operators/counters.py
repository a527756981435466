"""Counter repair and increments.

A cumulative counter sometimes reads zero. If it resumes at or above its last
value, the zeros were a reporting fault and are masked; if it resumes below,
the counter was reset. Both answers need values from far before and far after
the zeros, possibly in other files. They are found in two steps: every (head,
file, block) is reduced to one row, those rows exchange what they need, and
each block is then finished on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.constants import QUALITY_AGGREGATED, QUALITY_GAP, QUALITY_SINGLE
from spindle.operators.readings import BLOCK
from spindle.plans.slices import BEFORE_HERE, UP_TO_HERE

PART = ["head_id", *BLOCK]


def _forward() -> Window:
    return Window.partitionBy(*PART).orderBy("row_id")


def _known_before() -> Column:
    """Last count that is not missing, earlier in the block."""
    return F.last("count", ignorenulls=True).over(_forward().rowsBetween(*BEFORE_HERE))


def _is_zero() -> Column:
    return F.coalesce(F.col("count") == 0, F.lit(False))


def block_summary(readings: DataFrame) -> DataFrame:
    """What one block of one head tells its neighbours.

    `opens_zero`/`closes_zero`: the first/last row is zero. `after_opening`: the
    value next to the opening zeros. `before_closing`: the last known value
    before the closing zeros. `last_known`, `first_positive`, `first_value`: as
    named. Values sit in one-field structs so that a missing value at the place
    asked for differs from there being no such place.
    """
    rows = readings.select(*PART, "file_seq", "row_id", "count", _is_zero().alias("_z"), _known_before().alias("_before"))
    known = F.coalesce("count", "_before")
    at = lambda condition, value: F.when(condition, F.struct("row_id", value.alias("v")))
    count, zero = F.col("count"), F.col("_z")
    table = rows.groupBy(*PART).agg(
        F.max("file_seq").alias("file_seq"),
        F.min(F.struct("row_id", F.col("_z").alias("v"), F.col("count").alias("c"))).alias("_first"),
        F.max(F.struct("row_id", F.col("_z").alias("v"), known.alias("k"))).alias("_last"),
        F.min(at(~zero, count)).alias("_after"),
        F.max(at(~zero, known)).alias("_closing"),
        F.min(at(count != 0, count)).alias("_positive"),
    )
    return table.select(
        *PART,
        "file_seq",
        _era().alias("era"),
        F.col("_first.v").alias("opens_zero"),
        F.col("_first.c").alias("first_value"),
        F.col("_last.v").alias("closes_zero"),
        F.col("_last.k").alias("last_known"),
        F.col("_after").isNull().alias("all_zero"),
        F.col("_after.v").alias("after_opening"),
        F.col("_closing.v").alias("before_closing"),
        F.col("_positive.v").alias("first_positive"),
    )


def _era() -> Column:
    """A head missing from a file starts afresh in the next file that has it:
    eras number its unbroken sequences of files."""
    files = Window.partitionBy("head_id").orderBy("file_seq")
    return F.col("file_seq") - F.dense_rank().over(files)


def block_context(summary: DataFrame) -> DataFrame:
    """What every (head, block) must know of the rest of the series of the head.

    `open_before`: the value before the zeros it opens with. `close_after`: the
    value after the zeros it closes with, and `at_file_end`, whether those reach
    the end of their file. `in_file_before`: the last known value earlier in the
    file. `valid_before`: the last value that survives masking.
    """
    order = ["file_seq", "block"]
    series = Window.partitionBy("head_id").orderBy(*order)
    reverse = Window.partitionBy("head_id").orderBy(*[F.desc(o) for o in order])
    in_file = Window.partitionBy("head_id", "source_file").orderBy("block")
    era = Window.partitionBy("head_id", "era").orderBy(*order).rowsBetween(*BEFORE_HERE)
    same = lambda w: F.coalesce(F.lag("source_file").over(w) == F.col("source_file"), F.lit(False))

    t = summary.withColumns(
        {
            "_file_first": ~same(series),
            "_file_last": ~same(reverse),
            "_follows_zero": F.coalesce(F.lag("closes_zero").over(series), F.lit(False)),
            "_precedes_zero": F.coalesce(F.lag("opens_zero").over(reverse), F.lit(False)),
            "_next_value": F.lag("first_value").over(reverse),
            "in_file_before": F.last("last_known", ignorenulls=True).over(in_file.rowsBetween(*BEFORE_HERE)),
            # the next counted value of the head, in whatever file
            "_later": F.last("first_positive", ignorenulls=True).over(reverse.rowsBetween(*BEFORE_HERE)),
        }
    )
    continues = ~F.col("_file_first") & F.col("_follows_zero")
    goes_on = ~F.col("_file_last") & F.col("_precedes_zero")

    # A run of zeros that starts in this block fixes the value before it; a
    # block of zeros that continues a run passes on what it was told.
    side = lambda value, at_edge: F.struct(value.alias("v"), at_edge.alias("edge"))
    before = (
        F.when(~F.col("all_zero"), side(F.coalesce("before_closing", "in_file_before"), F.lit(False)))
        .when(F.col("_file_first"), side(F.lit(None).cast("double"), F.lit(True)))
        .when(~F.col("_follows_zero"), side(F.col("in_file_before"), F.lit(False)))
    )
    after = (
        F.when(~F.col("all_zero"), side(F.col("after_opening"), F.lit(False)))
        .when(F.col("_file_last"), side(F.col("_later"), F.lit(True)))
        .when(~F.col("_precedes_zero"), side(F.col("_next_value"), F.lit(False)))
    )
    t = t.withColumns(
        {
            "_close": F.last(before, ignorenulls=True).over(series.rowsBetween(*UP_TO_HERE)),
            "_open_after": F.last(after, ignorenulls=True).over(reverse.rowsBetween(*UP_TO_HERE)),
        }
    )
    t = t.withColumns(
        {
            "_open": F.when(F.col("_file_first"), side(F.lit(None).cast("double"), F.lit(True)))
            .when(continues, F.lag("_close").over(series))
            .otherwise(side(F.col("in_file_before"), F.lit(False))),
            "_close_after": F.when(F.col("_file_last"), side(F.col("_later"), F.lit(True)))
            .when(goes_on, F.lag("_open_after").over(reverse))
            .otherwise(side(F.col("_next_value"), F.lit(False))),
        }
    )
    t = t.withColumns(
        {"close_after": F.col("_close_after.v"), "at_file_end": F.col("_close_after.edge")}
    )
    # The last value the block leaves behind. Zeros reaching back to the start
    # of a file leave nothing while they may still be masked: whatever was known
    # before them then also decides about them.
    closing = F.col("closes_zero")
    masked = _masks(F.col("_close.v"), F.col("close_after"))
    # no later count is known: more data may yet mask these zeros
    open_end = F.col("at_file_end") & F.col("close_after").isNull()
    undecided = F.col("_close.edge") & (F.col("close_after").isNotNull() | F.col("at_file_end"))
    kept = masked | F.coalesce(open_end & (F.col("_close.v") > 0), F.lit(False))
    left = (
        F.when(F.col("last_known") != 0, F.col("last_known"))
        .when(F.col("last_known").isNotNull() & ~closing, F.lit(0.0))
        .when(closing & ~undecided, F.when(kept, F.col("_close.v")).otherwise(F.lit(0.0)))
    )
    t = t.withColumn("_left", left)
    t = t.withColumn("_carried", F.last("_left", ignorenulls=True).over(era))
    decided = lambda s: F.when(F.col(f"{s}.edge"), F.col("_carried")).otherwise(F.col(f"{s}.v"))
    t = t.withColumns({"open_before": decided("_open"), "close_before": decided("_close")})
    survives = F.when(
        closing, F.when(_masks(F.col("close_before"), F.col("close_after")), F.col("close_before")).otherwise(F.lit(0.0))
    ).otherwise(F.col("last_known"))
    t = t.withColumn("_valid", survives)
    return t.withColumn("valid_before", F.last("_valid", ignorenulls=True).over(era)).select(
        *PART, "open_before", "close_after", "at_file_end", "in_file_before", "valid_before"
    )


def _masks(before: Column, after: Column) -> Column:
    return F.coalesce((before > 0) & (after >= before), F.lit(False))


def mask_corrupted_counts(readings: DataFrame) -> DataFrame:
    """Add `masked` and `valid_count`, the count with reporting faults removed,
    and `previous_valid`, the last valid count of the head before the row.

    `undecided` marks zeros that stay only because no later count is known: more
    data may still mask them.
    """
    context = block_context(block_summary(readings))
    rows = readings.join(context, PART)
    forward, backward = _forward(), Window.partitionBy(*PART).orderBy(F.desc("row_id"))
    zero = _is_zero()

    # from the end: the value after each run of zeros
    block_end = F.row_number().over(backward) == 1
    ends = zero & (block_end | ~F.coalesce(F.lag(zero).over(backward), F.lit(False)))
    value_after = F.when(block_end, F.struct(F.col("close_after").alias("v"), F.col("at_file_end").alias("edge")))
    value_after = value_after.otherwise(
        F.struct(F.lag("count").over(backward).alias("v"), F.lit(False).alias("edge"))
    )
    rows = rows.withColumns({"_ends": ends, "_value_after": value_after})
    after = F.last(F.when(F.col("_ends"), F.col("_value_after")), ignorenulls=True)
    rows = rows.withColumn("_after", after.over(backward.rowsBetween(*UP_TO_HERE)))

    # from the start: the value before each run, then the repaired series
    block_start = F.row_number().over(forward) == 1
    starts = zero & (block_start | ~F.coalesce(F.lag(zero).over(forward), F.lit(False)))
    value_before = F.when(block_start, F.col("open_before")).otherwise(
        F.coalesce(_known_before(), F.col("in_file_before"))
    )
    rows = rows.withColumns({"_starts": starts, "_value_before": value_before})
    before = F.last(F.when(F.col("_starts"), F.struct("_value_before")), ignorenulls=True)
    rows = rows.withColumn("_before", before.over(forward.rowsBetween(*UP_TO_HERE))["_value_before"])
    open_end = F.col("_after.v").isNull() & F.col("_after.edge") & (F.col("_before") > 0)
    rows = rows.withColumns(
        {
            "masked": zero & _masks(F.col("_before"), F.col("_after.v")),
            "undecided": F.coalesce(zero & open_end, F.lit(False)),
        }
    )
    rows = rows.withColumn("valid_count", F.when(~F.col("masked"), F.col("count")))
    previous = F.last("valid_count", ignorenulls=True).over(forward.rowsBetween(*BEFORE_HERE))
    rows = rows.withColumn("previous_valid", F.coalesce(previous, F.col("valid_before")))
    return rows.select(*readings.columns, "masked", "undecided", "valid_count", "previous_valid")


def counter_deltas(masked: DataFrame) -> DataFrame:
    """Change against the last valid count; null on masked and first readings."""
    return masked.withColumn("counter_delta", F.col("valid_count") - F.col("previous_valid"))


def reset_segments(deltas: DataFrame) -> DataFrame:
    """The readings at which the counter moved, with `segment_id`, the number of
    resets of the head up to and including the row."""
    reset = F.when(F.col("counter_delta") < 0, 1).otherwise(0)
    per_block = deltas.groupBy(*PART).agg(F.sum(reset).alias("_resets"), F.max("file_seq").alias("file_seq"))
    earlier = Window.partitionBy("head_id", "era").orderBy("file_seq", "block").rowsBetween(*BEFORE_HERE)
    carry = per_block.withColumn("era", _era()).select(
        *PART, F.coalesce(F.sum("_resets").over(earlier), F.lit(0)).alias("_carry")
    )
    here = F.sum(reset).over(_forward().rowsBetween(*UP_TO_HERE))
    moved = deltas.where(F.col("counter_delta") != 0)
    return moved.join(carry, PART).withColumn("segment_id", F.col("_carry") + here).drop("_carry")


def counter_resets(segmented: DataFrame) -> DataFrame:
    """The log of counters running backwards."""
    return segmented.where(F.col("counter_delta") < 0).select(
        "timestamp",
        "head_id",
        F.col("previous_valid").alias("previous_count"),
        F.col("valid_count").alias("new_count"),
        (F.col("segment_id") - 1).alias("segment_before"),
        F.col("segment_id").alias("segment_after"),
        "source_file",
    )


def detect_closures(segmented: DataFrame) -> DataFrame:
    """One event per increment; a jump keeps the one reading observed for it."""
    delta = F.col("counter_delta")
    quality = (
        F.when(F.col("is_gap"), QUALITY_GAP).when(delta > 1, QUALITY_AGGREGATED).otherwise(QUALITY_SINGLE)
    )
    whole = lambda c: F.col(c).cast("long")
    return segmented.where(delta > 0).select(
        "timestamp",
        "head_id",
        whole("segment_id").alias("segment_id"),
        whole("valid_count").alias("counter"),
        whole("counter_delta").alias("counter_delta"),
        whole("counter_delta").alias("inferred_closure_count"),
        quality.alias("data_quality"),
        "torque_nm",
        F.col("status_code").cast("int").alias("status_code"),
        "source_file",
    )
