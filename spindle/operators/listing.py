"""Newest matching events, and how many match in all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.operators.filters import (
    check_choice,
    failed_closures,
    filter_events,
    real_closures,
    successful_closures,
)

OUTCOMES = ("all", "successful", "failed")


def matching_events(
    events: DataFrame, outcome: str = "all", heads=None, time_range=None, torque_min=None, torque_max=None
) -> DataFrame:
    check_choice("outcome", outcome, OUTCOMES)
    found = real_closures(filter_events(events, heads, time_range))
    if outcome == "successful":
        found = successful_closures(found)
    elif outcome == "failed":
        found = failed_closures(found)
    if torque_min is not None:
        found = found.where(F.col("torque_nm") >= torque_min)
    if torque_max is not None:
        found = found.where(F.col("torque_nm") <= torque_max)
    return found


def list_events(
    events: DataFrame,
    outcome: str = "all",
    heads=None,
    time_range=None,
    torque_min=None,
    torque_max=None,
    limit: int = 200,
) -> DataFrame:
    """The `limit` newest matches; head and counter break ties of time."""
    found = matching_events(events, outcome, heads, time_range, torque_min, torque_max)
    newest = [F.desc("timestamp"), F.asc("head_id"), F.asc("counter")]
    return (
        found.orderBy(*newest)
        .limit(limit)
        .select("timestamp", "head_id", "status_code", "status_label", "torque_nm")
    )


def list_events_total(
    events: DataFrame,
    outcome: str = "all",
    heads=None,
    time_range=None,
    torque_min=None,
    torque_max=None,
    limit: int = 200,
) -> DataFrame:
    found = matching_events(events, outcome, heads, time_range, torque_min, torque_max)
    n = F.count(F.lit(1))
    return found.agg(n.alias("total_matching"), (n > limit).alias("truncated"))
