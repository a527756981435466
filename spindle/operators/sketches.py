"""Approximate torque quantiles from stored sketches of days.

A KLL sketch of the successful closures of each head and day has a size that
does not grow with the day. Sketches of any days, heads or both merge, so that
quantiles over a year read a few kilobytes per head and day instead of the
events. Exact quantiles stay the default everywhere (`torque_statistics`).
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.operators.filters import check_choice, filter_events, successful_closures

SIZE = 400  # the parameter k of a sketch
RANK_ERROR = 0.02  # of a quantile, as a share of the readings; some three times what 99 in 100 sketches of this size keep
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
KEYS = {"overall": [], "per_head": ["head_id"], "daily": ["day"]}


def daily_sketches(events: DataFrame) -> DataFrame:
    """(day, head_id, n_observations, sketch) of the torque of successful closures.
    Readings that are missing or not a number are left out."""
    torque = F.col("torque_nm")
    good = successful_closures(events).where(torque.isNotNull() & ~F.isnan(torque))
    keyed = good.select(F.to_date("timestamp").alias("day"), "head_id", "torque_nm")
    return keyed.groupBy("day", "head_id").agg(
        F.count(F.lit(1)).alias("n_observations"), F.kll_sketch_agg_double("torque_nm", SIZE).alias("sketch")
    )


def approximate_quantiles(
    sketches: DataFrame,
    group_by: str = "per_head",
    heads=None,
    days: tuple[datetime.date | str, datetime.date | str] | None = None,
    probabilities: dict[str, float] = QUARTILES,
) -> DataFrame:
    """Number of readings and quantiles of each group, from the sketches of the
    days from the first to the last of `days`, both included. The rank of each
    quantile is right within RANK_ERROR of the readings. Without a sketch in
    the range there is no row."""
    check_choice("group_by", group_by, tuple(KEYS))
    some = filter_events(sketches, heads)
    if days:
        some = some.where(F.col("day").between(*(F.lit(str(d)).cast("date") for d in days)))
    keys = KEYS[group_by]
    merged = some.groupBy(*keys).agg(F.sum("n_observations").alias("n_observations"), F.kll_merge_agg_double("sketch", SIZE).alias("sketch"))
    quantiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probabilities.items()]
    return merged.where("n_observations > 0").select(*keys, "n_observations", *quantiles)


def rank_errors(events: DataFrame, quantiles: DataFrame, probabilities: dict[str, float] = QUARTILES) -> DataFrame:
    """How far the quantiles of heads are from their exact ranks: (head_id,
    n_observations, largest_error), counted over the events. The error of a
    value is the distance of its probability from the share of readings below it
    to the share of those up to it."""
    good = successful_closures(events).where(F.col("torque_nm").isNotNull() & ~F.isnan("torque_nm")).select("head_id", "torque_nm")
    near = good.join(F.broadcast(quantiles.select("head_id", *probabilities)), "head_id")  # a row per head
    x, counts = F.col("torque_nm"), [F.count(F.lit(1)).alias("n_observations")]
    for name in probabilities:
        counts += [F.count(F.when(x < F.col(name), 1)).alias(f"_{name}_below"), F.count(F.when(x <= F.col(name), 1)).alias(f"_{name}_upto")]
    n = F.col("n_observations")
    off = [F.greatest(F.col(f"_{name}_below") / n - p, p - F.col(f"_{name}_upto") / n, F.lit(0.0)) for name, p in probabilities.items()]
    largest = F.greatest(*off) if len(off) > 1 else off[0]
    return near.groupBy("head_id").agg(*counts).select("head_id", "n_observations", largest.alias("largest_error"))
