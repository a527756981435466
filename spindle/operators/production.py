"""Throughput, speed and machine idle time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.constants import QUALITY_GAP
from spindle.functions import columns as C
from spindle.operators.filters import (
    filter_events,
    outside,
    real_closures,
    spread,
    timestamp_literal,
)
from spindle.plans.asof import latest_intervals
from spindle.plans.distribution import exact_quantiles

LONGEST = 10


def tag_idle(events: DataFrame, idle: DataFrame) -> DataFrame:
    """Add `in_idle`: the event lies in the latest idle interval begun before
    it; and `crosses_idle`: the latest idle end lies between the previous event
    of the head and this one, so its speed is not a production speed."""
    seen = latest_intervals(events, idle)
    at = F.col("_at")
    previous = at - F.round(F.col("time_since_last_closure") * 1_000_000).cast("long")
    in_idle = at <= F.col("_open_end")
    crosses = (previous <= F.col("_closed_end")) & (at > F.col("_closed_end"))
    return seen.withColumns(
        {
            "in_idle": F.coalesce(in_idle, F.lit(False)),
            "crosses_idle": F.coalesce(crosses, F.lit(False)),
        }
    ).drop("_at", "_open_start", "_open_end", "_closed_end")


def production(
    events: DataFrame, idle: DataFrame | None = None, heads=None, time_range=None, exclude_idle: bool = True
) -> DataFrame:
    """Real closures with a speed, outside idle intervals; `crosses_idle` marks
    those that count as pieces but not as speed samples."""
    timed = real_closures(filter_events(events, heads, time_range)).where(
        F.col("capping_speed_pph").isNotNull()
    )
    if idle is None or not exclude_idle:
        return timed.withColumn("crosses_idle", F.lit(False))
    return tag_idle(timed, idle).where(~F.col("in_idle")).drop("in_idle")


def drop_events_in_idle(events: DataFrame, idle: DataFrame) -> DataFrame:
    return tag_idle(events, idle).where(~F.col("in_idle")).drop("in_idle", "crosses_idle")


def drop_idle_crossing_samples(events: DataFrame, idle: DataFrame) -> DataFrame:
    return tag_idle(events, idle).where(~F.col("crosses_idle")).drop("in_idle", "crosses_idle")


def excluded_speed_samples(produced: DataFrame) -> DataFrame:
    return produced.agg(C.count_if(F.col("crosses_idle")).alias("excluded"))


def _hourly(produced: DataFrame) -> DataFrame:
    gap = F.col("data_quality") == QUALITY_GAP
    pieces = F.col("inferred_closure_count")
    return produced.groupBy(C.hour("timestamp").alias("hour")).agg(
        F.sum(pieces).cast("double").alias("pieces_per_hour"),
        F.bool_or(gap).alias("gap_affected"),
        F.sum(F.when(gap, pieces)).alias("backlogged_closures"),
    )


def machine_timeline(produced: DataFrame) -> DataFrame:
    """Pieces of the whole machine per hour with production."""
    return timeline_of(_hourly(produced))


def timeline_of(hourly: DataFrame) -> DataFrame:
    return hourly.where(F.col("pieces_per_hour") > 0).select("hour", "pieces_per_hour", "gap_affected")


def machine_throughput(produced: DataFrame) -> DataFrame:
    return throughput_of(machine_timeline(produced))


def throughput_of(timeline: DataFrame) -> DataFrame:
    x = F.col("pieces_per_hour")
    return timeline.agg(
        F.avg(x).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.stddev_samp(x).alias("std"),
        F.count(x).alias("hours_with_production"),
    )


def gap_affected_hours(produced: DataFrame) -> DataFrame:
    """Hours credited with pieces made during an unsampled stretch."""
    return gap_hours_of(_hourly(produced))


def gap_hours_of(hourly: DataFrame) -> DataFrame:
    hourly = hourly.where(F.col("gap_affected"))
    shown = F.when(F.col("pieces_per_hour") > 0, F.col("pieces_per_hour")).otherwise(0.0)
    return hourly.select("hour", shown.alias("pieces_per_hour"), "backlogged_closures")


def throughput_anomalies(produced: DataFrame) -> DataFrame:
    return throughput_anomalies_of(machine_timeline(produced))


def throughput_anomalies_of(timeline: DataFrame) -> DataFrame:
    timeline = timeline.select("hour", "pieces_per_hour")
    marked = timeline.withColumn("_s", spread(timeline, "pieces_per_hour"))
    x = F.col("pieces_per_hour")
    kind = F.when(x < F.col("_s.mean"), "slowdown").otherwise("speedup")
    return marked.where(outside(x, F.col("_s"), "both")).select("hour", "pieces_per_hour", kind.alias("type"))


def head_speed(produced: DataFrame) -> DataFrame:
    x = F.col("capping_speed_pph")
    return produced.where(~F.col("crosses_idle")).agg(
        F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_samp(x).alias("std")
    )


def head_speed_timeline(produced: DataFrame) -> DataFrame:
    samples = produced.where(~F.col("crosses_idle"))
    return samples.groupBy(C.hour("timestamp").alias("hour")).agg(
        F.avg("capping_speed_pph").alias("mean_speed_pph")
    )


def head_speed_variability(produced: DataFrame) -> DataFrame:
    x = F.col("capping_speed_pph")
    samples = produced.where(~F.col("crosses_idle"))
    per_head = samples.groupBy("head_id").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    return per_head.withColumn("cv", C.ratio("std", "mean"))


# --- idle time ---------------------------------------------------------------


def _range_columns(time_range) -> tuple[Column, Column]:
    """The two ends of a range given as values or as a one-row table."""
    if isinstance(time_range, DataFrame):
        ends = time_range.select(F.struct("start_time", "end_time")).scalar()
        return ends["start_time"], ends["end_time"]
    start, end = time_range
    if _naive(end) <= _naive(start):
        raise ValueError("time_range end must be after start")
    return timestamp_literal(start), timestamp_literal(end)


def _naive(value):
    from datetime import datetime

    return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))


def clip_idle(idle: DataFrame, time_range=None) -> DataFrame:
    """Idle intervals that overlap the range, cut to it."""
    if time_range is None:
        return idle.select("start_time", "end_time", "duration_seconds")
    low, high = _range_columns(time_range)
    overlapping = idle.where((F.col("start_time") < high) & (F.col("end_time") > low))
    cut = overlapping.select(
        F.greatest("start_time", low).alias("start_time"), F.least("end_time", high).alias("end_time")
    )
    return cut.withColumn("duration_seconds", C.seconds_between("start_time", "end_time"))


def utilization(idle: DataFrame, time_range=None) -> DataFrame:
    """Share of the window that is not idle, and the idle interval figures. The
    window is the range, else the span of the idle intervals."""
    clipped = clip_idle(idle, time_range)
    d = F.col("duration_seconds")
    stats = clipped.agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(d).alias("mean_duration_s"),
        F.max(d).alias("max_duration_s"),
        F.sum(d).alias("total_idle_seconds"),
        C.seconds_between(F.min("start_time"), F.max("end_time")).alias("_span"),
    )
    median = exact_quantiles(clipped, [], "duration_seconds", {"median": 0.5}).scalar()
    if time_range is None:
        window = F.col("_span")
    else:
        window = C.seconds_between(*_range_columns(time_range))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    productive = F.greatest(F.col("observation_seconds") - zero(F.col("total_idle_seconds")), F.lit(0.0))
    return (
        stats.withColumns({"median_duration_s": median, "observation_seconds": window})
        .withColumn("productive_seconds", F.when(F.col("observation_seconds").isNotNull(), productive))
        .select(
            "count",
            *[
                zero(F.col(c)).alias(c)
                for c in ("mean_duration_s", "median_duration_s", "max_duration_s", "total_idle_seconds")
            ],
            C.ratio("productive_seconds", "observation_seconds").alias("utilization_rate"),
            (F.col("observation_seconds") / 3600.0).alias("observation_window_hours"),
            (F.col("productive_seconds") / 3600.0).alias("productive_hours"),
        )
    )


def idle_by_hour_of_day(idle: DataFrame, time_range=None) -> DataFrame:
    """Idle seconds per hour of the day: intervals are cut at full hours."""
    clipped = clip_idle(idle, time_range).where(F.col("start_time") < F.col("end_time"))
    hours = F.sequence(C.hour("start_time"), F.col("end_time"), F.expr("interval 1 hour"))
    pieces = clipped.withColumn("_hour", F.explode(hours))
    begin = F.greatest("start_time", "_hour")
    end = F.least(F.col("end_time"), F.col("_hour") + F.expr("interval 1 hour"))
    per_hour = pieces.groupBy(F.hour("_hour").alias("hour")).agg(
        F.sum(C.seconds_between(begin, end)).alias("idle_seconds")
    )
    day = idle.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return day.join(F.broadcast(per_hour), "hour", "left").na.fill(0.0, ["idle_seconds"])


def longest_idle(idle: DataFrame, time_range=None, n: int = LONGEST) -> DataFrame:
    return clip_idle(idle, time_range).orderBy(F.desc("duration_seconds"), "start_time").limit(n)
