"""Unusual torque readings, and hours with unusually many rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.constants import REASON_ABOVE, REASON_BELOW
from spindle.functions import columns as C
from spindle.operators.filters import (
    check_choice,
    filter_events,
    outside,
    real_closures,
    spread,
    successful_closures,
)
from spindle.plans.distribution import exact_quantiles

MAX_EVENTS = 500
METHODS = ("zscore", "iqr", "threshold")


def head_bounds(real: DataFrame, method: str, sensitivity: float = 3.0) -> DataFrame:
    """Expected torque range per head, learned from its good closures."""
    good = successful_closures(real)
    if method == "zscore":
        stats = good.groupBy("head_id").agg(
            F.avg("torque_nm").alias("_mid"), (sensitivity * F.stddev_samp("torque_nm")).alias("_reach")
        )
        return stats.select(
            "head_id",
            (F.col("_mid") - F.col("_reach")).alias("lower"),
            (F.col("_mid") + F.col("_reach")).alias("upper"),
        )
    quartiles = exact_quantiles(good, ["head_id"], "torque_nm", {"q1": 0.25, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return quartiles.select(
        "head_id", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper")
    )


def anomalies(
    events: DataFrame,
    method: str = "zscore",
    threshold_range: tuple[float, float] | None = None,
    sensitivity: float = 3.0,
    heads=None,
    time_range=None,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Every real closure with a torque strictly outside its expected range.
    `bounds` are those of `head_bounds`, where they are known already."""
    check_choice("method", method, METHODS)
    if method == "threshold" and threshold_range is None:
        raise ValueError("the method threshold needs a threshold_range of two torques")
    real = real_closures(filter_events(events, heads, time_range))
    if method == "threshold":
        low, high = map(float, threshold_range)
        ranged = real.withColumns({"lower": F.lit(low), "upper": F.lit(high)})
    else:
        # at most MAX_HEAD_IDS rows
        ranged = real.join(F.broadcast(head_bounds(real, method, sensitivity) if bounds is None else bounds), "head_id")
    x, lower, upper = F.col("torque_nm"), F.col("lower"), F.col("upper")
    below = x < lower
    told = lambda parts, bound: F.concat(
        F.lit(parts[0]), F.round(x, 3).cast("string"), F.lit(parts[1]), F.round(bound, 3).cast("string")
    )
    return ranged.where(below | (x > upper)).withColumns(
        {
            "deviation": F.greatest(lower - x, x - upper),
            "reason": F.when(below, told(REASON_BELOW, lower)).otherwise(told(REASON_ABOVE, upper)),
        }
    )


def top_anomalies(flagged: DataFrame, max_events: int = MAX_EVENTS) -> DataFrame:
    """The worst deviations first; time, head and counter break ties."""
    worst = [F.desc("deviation"), F.asc("timestamp"), F.asc("head_id"), F.asc("counter")]
    return (
        flagged.orderBy(*worst)
        .limit(max_events)
        .select("timestamp", "head_id", "torque_nm", "status_code", "deviation", "reason")
    )


def anomalies_per_head(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("head_id").agg(F.count(F.lit(1)).alias("n_anomalies"))


def anomalies_total(flagged: DataFrame, max_events: int = MAX_EVENTS) -> DataFrame:
    n = F.count(F.lit(1))
    return flagged.agg(
        n.alias("total_anomalies"),
        F.countDistinct("head_id").alias("n_heads"),
        (n > max_events).alias("truncated"),
    )


def hourly_failure_spikes(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    """Hours whose share of rejects is two deviations above the mean hour."""
    real = real_closures(filter_events(events, heads, time_range))
    hourly = real.groupBy(C.hour("timestamp").alias("hour_start")).agg(
        F.avg(F.col("is_reject").cast("double")).alias("failure_rate"),
        F.count(F.lit(1)).alias("n_events"),
    )
    marked = hourly.withColumn("_s", spread(hourly, "failure_rate"))
    return marked.where(outside(F.col("failure_rate"), F.col("_s"), "above")).drop("_s")
