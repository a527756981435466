"""Row filters and time grids every analysis starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.constants import IDLE_CODE, SUCCESS_CODE
from spindle.functions import columns as C

TimeRange = tuple
POPULATIONS = ("successful_only", "failed_only", "all_real", "all")


def timestamp_literal(value) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def check_choice(name: str, value, allowed: Sequence[str]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {sorted(allowed)}, got {value!r}")


def filter_events(
    events: DataFrame, heads: Sequence[str] | None = None, time_range: TimeRange | None = None
) -> DataFrame:
    """Keep the given heads and the closed interval [start, end]."""
    if heads:
        events = events.where(F.col("head_id").isin(*heads))
    if time_range:
        start, end = map(timestamp_literal, time_range)
        events = events.where(F.col("timestamp").between(start, end))
        if "event_date" in events.columns:  # skip the folders of other days
            events = events.where(F.col("event_date").between(F.to_date(start), F.to_date(end)))
    return events


def real_closures(events: DataFrame) -> DataFrame:
    return events.where(F.col("status_code") != IDLE_CODE)


def successful_closures(events: DataFrame) -> DataFrame:
    return events.where(F.col("status_code") == SUCCESS_CODE)


def failed_closures(events: DataFrame) -> DataFrame:
    return events.where(F.col("is_reject"))


def status_population(events: DataFrame, kind: str) -> DataFrame:
    check_choice("filter_status", kind, POPULATIONS)
    chosen = {
        "successful_only": successful_closures,
        "failed_only": failed_closures,
        "all_real": real_closures,
        "all": lambda df: df,
    }
    return chosen[kind](events)


def effective_time_range(events: DataFrame, requested: TimeRange | None = None) -> DataFrame:
    """One row (start_time, end_time): the requested range, else the span of the
    events; no row when there is neither."""
    if requested is not None:
        one = events.sparkSession.range(1)
        start, end = map(timestamp_literal, requested)
        return one.select(start.alias("start_time"), end.alias("end_time"))
    span = events.agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
    return span.where(F.col("start_time").isNotNull())


def time_presets(events: DataFrame) -> DataFrame:
    """Ready-made ranges: the last 7 and 30 days, each calendar month present
    (clipped to the data) and the full data set (no bounds)."""
    span = effective_time_range(events)
    first, last = F.col("start_time"), F.col("end_time")

    def entry(key, label, start, end):
        return F.struct(
            key.alias("key"), label.alias("label"), start.alias("range_start"), end.alias("range_end")
        )

    month_of = lambda ts: F.date_trunc("month", ts).cast("timestamp_ntz")
    months = F.expr(
        "sequence(cast(date_trunc('month', start_time) as timestamp_ntz),"
        " cast(date_trunc('month', end_time) as timestamp_ntz), interval 1 month)"
    )
    by_month = F.transform(
        months,
        lambda month, i: entry(
            F.concat(F.lit("m"), i.cast("string")),
            F.date_format(month, "MMMM"),
            F.greatest(month, first),
            F.least(month_of(month + F.expr("interval 32 days")) - F.expr("interval 1 microsecond"), last),
        ),
    )
    nothing = F.lit(None).cast("timestamp_ntz")
    fixed = F.array(
        entry(F.lit("7d"), F.lit("Last 7 days"), last - F.expr("interval 7 days"), last),
        entry(F.lit("30d"), F.lit("Last 30 days"), last - F.expr("interval 30 days"), last),
        entry(F.lit("full"), F.lit("Full Dataset"), nothing, nothing),
    )
    return span.select(F.inline(F.concat(fixed, by_month)))


def time_bucket(group_by: str) -> Column:
    """The grouping key of a named grid."""
    return {
        "overall": F.lit("overall"),
        "per_head": F.col("head_id"),
        "daily": C.day("timestamp"),
        "hourly": C.hour("timestamp"),
        "per_file": F.col("source_file"),
    }[group_by]


def bucket_label(group_by: str, key: Column) -> Column:
    if group_by in ("daily", "hourly"):
        return F.date_format(key, "yyyy-MM-dd HH:mm:ss")
    return key.cast("string")


def spread(table: DataFrame, value: str) -> Column:
    """Mean, population deviation and count of a column of `table`, as one
    scalar struct that can be compared with every row."""
    moments = F.struct(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n")
    )
    return table.agg(moments).scalar()


def outside(value: Column, s: Column, side: str, sigmas: float = 2.0) -> Column:
    """Is the value more than `sigmas` deviations off? Never with fewer than two
    values or without any spread."""
    usable = (s["n"] >= 2) & (s["sd"] > 0)
    limit = F.lit(sigmas) * s["sd"]
    off = {
        "below": value < s["mean"] - limit,
        "above": value > s["mean"] + limit,
        "both": F.abs(value - s["mean"]) > limit,
    }[side]
    return F.coalesce(usable & off, F.lit(False))
