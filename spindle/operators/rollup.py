"""Hourly cells: what most analyses need of the events, in one pass.

A cell holds the counts and moments of the events of one hour, head, status and
idle tag. Cells merge: key figures of any range of whole hours come from stored
cells, and only the hours that a range cuts are counted from the events again.
There are as many cells as hours times heads times statuses, however many events
they stand for.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.constants import IDLE_CODE, QUALITY_GAP, SUCCESS_CODE
from spindle.functions import columns as C
from spindle.operators import failures, heads, production, summary
from spindle.operators.filters import bucket_label, check_choice, filter_events, outside, spread

KEYS = ["hour", "head_id", "status_code", "is_successful", "is_reject", "is_gap", "timed", "in_idle", "crosses_idle"]
VALUES = {"torque": "torque_nm", "speed": "capping_speed_pph"}
GROUPINGS = ("overall", "per_head", "daily", "hourly")


def hourly_cells(events: DataFrame, idle: DataFrame | None = None) -> DataFrame:
    """One row per hour, head, status, outcome and idle tag: `n` events, `closures`
    inferred, first and last time, and count, mean, sum of squares around it,
    least and greatest of torque and speed."""
    if idle is None:
        tagged = events.withColumns({"in_idle": F.lit(False), "crosses_idle": F.lit(False)})
    else:
        tagged = production.tag_idle(events, idle)
    keyed = tagged.withColumns(
        {
            "hour": C.hour("timestamp"),
            "is_gap": F.coalesce(F.col("data_quality") == QUALITY_GAP, F.lit(False)),
            "timed": F.col("capping_speed_pph").isNotNull(),
        }
    )
    moments = [
        column.alias(f"{name}_{part}")
        for name, value in VALUES.items()
        for part, column in {
            "n": F.count(value),
            "mean": F.avg(value),
            "squares": F.var_pop(value) * F.count(value),
            "min": F.min(value),
            "max": F.max(value),
        }.items()
    ]
    return keyed.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("inferred_closure_count"), F.lit(0)).alias("closures"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
        *moments,
    )


def _times(time_range) -> tuple[datetime, datetime]:
    return tuple(t if isinstance(t, datetime) else datetime.fromisoformat(str(t)) for t in time_range)


def cells_in(cells: DataFrame, events: DataFrame, idle: DataFrame | None, time_range=None) -> DataFrame:
    """The cells of a closed range: stored ones of the hours that lie inside, and
    new ones of the events in the at most two hours that it cuts."""
    if time_range is None:
        return cells
    start, end = _times(time_range)
    hour, step = timedelta(hours=1), timedelta(microseconds=1)
    floor = lambda t: t.replace(minute=0, second=0, microsecond=0)
    first = floor(start) if floor(start) == start else floor(start) + hour
    beyond = floor(end + step)  # hours before this one end inside the range
    if first >= beyond:
        return hourly_cells(filter_events(events, None, (start, end)), idle)
    whole = cells.where((F.col("hour") >= F.lit(str(first)).cast("timestamp_ntz")) & (F.col("hour") < F.lit(str(beyond)).cast("timestamp_ntz")))
    ragged = [r for r in ((start, first - step), (beyond, end)) if r[0] <= r[1]]
    if not ragged:
        return whole
    parts = [filter_events(events, None, r) for r in ragged]
    return whole.unionByName(hourly_cells(parts[0].union(parts[1]) if len(parts) > 1 else parts[0], idle))


def merged(cells: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(keys, n, mean, std, min, max) of a value over cells."""
    part = lambda p: F.col(f"{name}_{p}")
    known = cells.where(part("n") > 0)
    sums = known.groupBy(*keys).agg(
        F.sum(part("n")).alias("n"),
        (F.sum(part("mean") * part("n")) / F.sum(part("n"))).alias("_mean"),
        F.min(part("min")).alias("min"),
        F.max(part("max")).alias("max"),
    )
    # one value only: exactly that one, and no spread
    level = F.col("min") == F.col("max")
    sums = sums.withColumn("mean", F.when(level, F.col("min")).otherwise(F.col("_mean"))).drop("_mean")
    off = part("mean") - F.col("_centre")
    if keys:
        centred = known.join(F.broadcast(sums.select(*keys, F.col("mean").alias("_centre"))), keys)  # a row per head or day
    else:
        centred = known.withColumn("_centre", sums.select("mean").scalar())
    squares = centred.groupBy(*keys).agg(F.sum(part("squares") + part("n") * off * off).alias("_squares"))
    both = sums.join(squares, keys) if keys else sums.withColumn("_squares", squares.scalar())
    std = F.when(level, F.lit(0.0)).otherwise(F.sqrt(F.col("_squares") / (F.col("n") - 1)))
    return both.select(*keys, "n", "mean", F.when(F.col("n") > 1, std).alias("std"), "min", "max")


def _real(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("status_code") != IDLE_CODE)


def _good(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("status_code") == SUCCESS_CODE)


def _produced(cells: DataFrame) -> DataFrame:
    return _real(cells).where(F.col("timed") & ~F.col("in_idle"))


def _count(condition: Column | None = None) -> Column:
    n = F.col("n") if condition is None else F.when(condition, F.col("n"))
    return F.coalesce(F.sum(n), F.lit(0))


def dataset_summary(cells: DataFrame) -> DataFrame:
    """As `summary.dataset_summary`."""
    code = F.col("status_code")
    failed = F.col("is_reject")
    kinds = {
        "successful": code == SUCCESS_CODE,
        "failed": failed,
        "no_load": code == IDLE_CODE,
        "other": F.coalesce((code != SUCCESS_CODE) & (code != IDLE_CODE) & ~failed, F.lit(True)),
    }
    totals = cells.agg(
        _count().alias("total_events"),
        F.coalesce(F.sum("closures"), F.lit(0)).alias("total_inferred_closures"),
        F.countDistinct("head_id").alias("n_heads"),
        F.array_join(F.array_sort(F.collect_set("head_id")), ",").alias("heads"),
        F.min("first_time").alias("start_time"),
        F.max("last_time").alias("end_time"),
        *[_count(condition).alias(kind) for kind, condition in kinds.items()],
    )
    return summary.described(totals)


def success_rate(cells: DataFrame, group_by: str = "overall") -> DataFrame:
    """As `summary.success_rate`, for the groups that cells tell apart."""
    check_choice("group_by", group_by, GROUPINGS)
    key = {"overall": F.lit("overall"), "per_head": F.col("head_id"), "daily": C.day("hour"), "hourly": F.col("hour")}[group_by]
    counts = _real(cells).groupBy(key.alias("_key")).agg(
        _count().alias("total_closures"),
        F.sum("closures").alias("inferred_closures"),
        _count(F.col("is_successful")).alias("successful"),
        _count(F.col("is_reject")).alias("failed"),
    )
    return summary.rates(counts, group_by, bucket_label(group_by, F.col("_key")))


def head_comparison(cells: DataFrame) -> DataFrame:
    """As `heads.head_comparison`."""
    real = F.col("status_code") != IDLE_CODE
    has_real = _count(real) > 0
    counts = cells.groupBy("head_id").agg(
        _count().alias("total_closures"),
        F.when(has_real, _count(real & F.col("is_successful"))).alias("successful"),
        F.when(has_real, _count(real & F.col("is_reject"))).alias("failed"),
    )
    torque = merged(cells.where(F.col("is_successful")), "torque", ["head_id"])
    torque = torque.select("head_id", F.col("mean").alias("mean_torque_nm"), F.col("std").alias("std_torque_nm"))
    return heads.compared(counts.join(F.broadcast(torque), "head_id", "left"))


def head_bounds(cells: DataFrame, sensitivity: float = 3.0) -> DataFrame:
    """As `anomaly.head_bounds` by z-score."""
    stats = merged(_good(cells), "torque", ["head_id"])
    reach = sensitivity * F.col("std")
    return stats.select("head_id", (F.col("mean") - reach).alias("lower"), (F.col("mean") + reach).alias("upper"))


def mean_torque(cells: DataFrame) -> DataFrame:
    return merged(_good(cells), "torque", []).select(F.col("mean").alias("mean_torque_nm"))


def production_hours(cells: DataFrame) -> DataFrame:
    """(hour, pieces_per_hour, gap_affected, backlogged_closures) of hours with
    production."""
    gap, pieces = F.col("is_gap"), F.col("closures")
    return _produced(cells).groupBy("hour").agg(
        F.sum(pieces).cast("double").alias("pieces_per_hour"),
        F.bool_or(gap).alias("gap_affected"),
        F.sum(F.when(gap, pieces)).alias("backlogged_closures"),
    )


def machine_throughput(cells: DataFrame) -> DataFrame:
    return production.throughput_of(production.timeline_of(production_hours(cells)))


def gap_affected_hours(cells: DataFrame) -> DataFrame:
    return production.gap_hours_of(production_hours(cells))


def head_speed(cells: DataFrame) -> DataFrame:
    return merged(_produced(cells).where(~F.col("crosses_idle")), "speed", []).select("mean", "min", "max", "std")


def head_speed_variability(cells: DataFrame) -> DataFrame:
    per_head = merged(_produced(cells).where(~F.col("crosses_idle")), "speed", ["head_id"])
    return per_head.select("head_id", "mean", "std", C.ratio("std", "mean").alias("cv"))


def failure_distribution(cells: DataFrame) -> DataFrame:
    return _real(cells).where(F.col("is_reject")).groupBy("status_code").agg(_count().alias("n_failures"))


def dominant_failure(cells: DataFrame) -> DataFrame:
    rejects = _real(cells).where(F.col("is_reject"))
    return failures.dominant_of(rejects.groupBy("head_id", "status_code").agg(_count().alias("count")))


def daily_failure_spikes(cells: DataFrame) -> DataFrame:
    counted = _real(cells).groupBy(C.day("hour").alias("day")).agg(_count(F.col("is_reject")).alias("n_failures"), _count().alias("_n"))
    return failures.spikes_of(counted)


def hourly_failure_spikes(cells: DataFrame) -> DataFrame:
    counted = _real(cells).groupBy(F.col("hour").alias("hour_start")).agg(
        (_count(F.col("is_reject")) / _count()).alias("failure_rate"), _count().alias("n_events")
    )
    marked = counted.withColumn("_s", spread(counted, "failure_rate"))
    return marked.where(outside(F.col("failure_rate"), F.col("_s"), "above")).drop("_s")


def failure_by_hour_of_day(cells: DataFrame) -> DataFrame:
    counted = _real(cells).groupBy(F.hour("hour").alias("hour")).agg(
        _count().alias("n_events"), _count(F.col("is_reject")).alias("n_failures")
    )
    return failures.all_hours(counted)


def failure_correlation(cells: DataFrame) -> DataFrame:
    counted = _real(cells).groupBy("hour", "head_id").agg(_count(F.col("is_reject")).cast("double").alias("failures"))
    return failures.correlated(counted)
