"""Torque distributions, trends and shifts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.constants import SUCCESS_CODE
from spindle.functions import columns as C
from spindle.functions.pvalues import correlation_p, mann_whitney_p
from spindle.operators.filters import (
    bucket_label,
    check_choice,
    filter_events,
    outside,
    spread,
    status_population,
    successful_closures,
    time_bucket,
)
from spindle.plans.distribution import histogram, moments_of, quantiles_of, rank_sums
from spindle.plans.slices import SLICE, UP_TO_HERE, chunked, running, slice_bounds, slice_index

GROUPINGS = ("overall", "per_head", "daily")
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
SIGNIFICANCE = 0.05
FLAT_SLOPE = 1e-9
CHUNK_ROWS = 65_536
TIME_LAG_ROWS = 10
INTERVAL_UNITS = {"D": 86400, "h": 3600, "min": 60, "s": 1}


def torque_statistics(
    events: DataFrame,
    filter_status: str = "successful_only",
    group_by: str = "overall",
    heads=None,
    time_range=None,
) -> DataFrame:
    """Moments, quartiles, outliers beyond 1.5 IQR and relative spread."""
    check_choice("group_by", group_by, GROUPINGS)
    subset = status_population(filter_events(events, heads, time_range), filter_status)
    key = time_bucket(group_by)
    readings = subset.select(bucket_label(group_by, key).alias("group"), "torque_nm")
    hist = histogram(readings, ["group"], "torque_nm")  # the only pass over the events
    moments = moments_of(hist, ["group"], "torque_nm")
    asked = {name: (p, "n") for name, p in QUARTILES.items()}
    quartiles = quantiles_of(hist, ["group"], "torque_nm", asked).withColumn("iqr", F.col("q3") - F.col("q1"))
    # one row per head or calendar day, so small enough to send to every task
    limits = F.broadcast(quartiles.select("group", "q1", "q3", "iqr"))
    x = F.col("torque_nm")
    beyond = (x < F.col("q1") - 1.5 * F.col("iqr")) | (x > F.col("q3") + 1.5 * F.col("iqr"))
    outliers = hist.join(limits, "group").groupBy("group").agg(
        F.sum(F.when(beyond, F.col("n")).otherwise(0)).alias("outlier_count")
    )
    table = (
        moments.join(quartiles, "group", "left")
        .join(outliers, "group", "left")
        .withColumn("outlier_count", F.coalesce("outlier_count", F.lit(0)))
        .withColumn("coefficient_of_variation", C.ratio("std", "mean"))
    )
    if group_by != "per_head":
        return table.withColumn("flagged_high_variability", F.lit(False))
    cv = moments.select(C.ratio("std", "mean").alias("cv"))
    return (
        table.withColumn("_s", spread(cv, "cv"))
        .withColumn(
            "flagged_high_variability", outside(F.col("coefficient_of_variation"), F.col("_s"), "above")
        )
        .drop("_s")
    )


def torque_trend(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    """Least-squares drift per head, in Nm per day, over successful closures."""
    good = successful_closures(filter_events(events, heads, time_range))
    days = C.micros("timestamp") / F.lit(86_400_000_000.0)
    return (
        good.withColumn("_days", days)
        .groupBy("head_id")
        .agg(
            F.regr_slope("torque_nm", "_days").alias("slope_nm_per_day"),
            F.regr_r2("torque_nm", "_days").alias("r_squared"),
            F.count(F.lit(1)).alias("n_events"),
        )
        .where(F.col("n_events") >= 2)
    )


def torque_trend_significance(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    """The trend with its p-value and direction."""
    trend = torque_trend(events, heads, time_range)
    r = F.signum("slope_nm_per_day") * F.sqrt("r_squared")
    real = F.col("p_value") < SIGNIFICANCE
    return (
        trend.withColumn("p_value", correlation_p(r, F.col("n_events").cast("double")))
        .withColumn("significant", F.coalesce(real, F.lit(False)))
        .withColumn(
            "direction",
            F.when(F.col("significant") & (F.col("slope_nm_per_day") > FLAT_SLOPE), "increasing")
            .when(F.col("significant") & (F.col("slope_nm_per_day") < -FLAT_SLOPE), "decreasing")
            .otherwise("stable"),
        )
    )


def torque_trend_summary(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    trend = torque_trend_significance(events, heads, time_range)
    return trend.agg(
        F.count(F.lit(1)).alias("n_heads"),
        C.count_if(F.col("significant")).alias("n_significant"),
        C.count_if(F.col("direction") == "increasing").alias("n_increasing"),
        C.count_if(F.col("direction") == "decreasing").alias("n_decreasing"),
        F.avg("r_squared").alias("mean_r_squared"),
        F.coalesce(F.avg("r_squared") < 0.01, F.lit(False)).alias("small_effect_caveat"),
    )


def _window_seconds(window_size: str) -> float:
    parsed = re.fullmatch(r"(\d+)\s*(D|h|min|s)", window_size)
    if not parsed:
        raise ValueError(f"not a time window: {window_size!r}")
    return int(parsed[1]) * INTERVAL_UNITS[parsed[2]]


def _positions(events: DataFrame, heads, time_range) -> tuple[DataFrame, list]:
    """Successful readings per head, numbered in time order and centred on the
    mean of the head, which keeps the running squares small; and the points at
    which their time is cut."""
    good = successful_closures(filter_events(events, heads, time_range)).select(
        "head_id", "timestamp", "counter", "torque_nm"
    )
    # at most MAX_HEAD_IDS rows
    heads_stats = F.broadcast(
        good.groupBy("head_id").agg(
            F.avg("torque_nm").alias("_centre"), F.stddev_samp("torque_nm").alias("_sd")
        )
    )
    timed = good.withColumn("_at", C.micros("timestamp"))
    cuts = slice_bounds(timed, "_at")
    timed = timed.withColumn(SLICE, slice_index("_at", cuts))
    numbered = running(timed, ["head_id"], ["_at", "counter"], {"_pos": F.lit(1)})
    centred = numbered.join(heads_stats, "head_id").withColumn("_x", F.col("torque_nm") - F.col("_centre"))
    return centred, cuts


def _moving(n: Column, s1: Column, s2: Column, min_rows: int) -> dict[str, Column]:
    variance = F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0))
    return {
        "moving_avg": F.when(n >= min_rows, F.col("_centre") + s1 / n),
        "moving_std": F.when(n >= max(2, min_rows), F.sqrt(variance)),
    }


def _rolling_rows(readings: DataFrame, rows: int, lag_rows: int) -> DataFrame:
    """Moving statistics over the last `rows` readings, from running sums."""
    halo = rows + lag_rows
    parts = chunked(readings, "_pos", max(CHUNK_ROWS, halo), halo)
    ordered = Window.partitionBy("head_id", "_chunk").orderBy("_pos")
    so_far = ordered.rowsBetween(*UP_TO_HERE)
    summed = parts.withColumns(
        {
            "_n": F.count("_x").over(so_far),
            "_s1": F.coalesce(F.sum("_x").over(so_far), F.lit(0.0)),
            "_s2": F.coalesce(F.sum(F.col("_x") * F.col("_x")).over(so_far), F.lit(0.0)),
        }
    )
    inside = {
        f"_w{c}": F.col(c) - F.lag(c, rows, 0).over(ordered) for c in ("_n", "_s1", "_s2")
    }
    moving = _moving(F.col("_w_n"), F.col("_w_s1"), F.col("_w_s2"), max(2, rows // 10))
    return summed.withColumns(inside).withColumns(moving)


def _rolling_time(readings: DataFrame, cuts: list, seconds: float, lag_rows: int) -> DataFrame:
    """Moving statistics over (t - window, t]: every reading enters the sums at
    its time and leaves them one window later."""
    x, width = F.col("_x"), int(seconds * 1_000_000)
    known = F.when(x.isNotNull(), 1).otherwise(0)

    def step(at, entering, sign):
        amounts = {"_dn": known * sign, "_d1": x * sign, "_d2": x * x * sign}
        parts = [v.alias(n) for n, v in amounts.items()]
        return F.struct(at.alias("_sort"), F.lit(entering).alias("_step"), *parts)

    steps = F.array(step(F.col("_at"), 1, 1), step(F.col("_at") + width, 0, -1))
    both = readings.drop(SLICE).withColumn("_e", F.explode(steps)).select("*", "_e.*").drop("_e")
    # cut at the times of entering and of leaving: neither crowds a slice
    both = both.withColumn(SLICE, slice_index("_sort", sorted({*cuts, *(c + width for c in cuts)})))
    summed = running(
        both,
        ["head_id"],
        ["_sort", "_step", "_pos"],
        {"_w_n": F.col("_dn"), "_w_s1": F.col("_d1"), "_w_s2": F.col("_d2")},
    ).where(F.col("_step") == 1)
    moved = summed.withColumns(_moving(F.col("_w_n"), F.col("_w_s1"), F.col("_w_s2"), 1))
    return chunked(moved, "_pos", CHUNK_ROWS, lag_rows + 1)


def _lag_rows(window_size) -> int:
    return max(TIME_LAG_ROWS, window_size // 10) if isinstance(window_size, int) else TIME_LAG_ROWS


def _rolling(events: DataFrame, window_size, heads, time_range, lag_rows: int = 0) -> DataFrame:
    if not isinstance(window_size, int):
        seconds = _window_seconds(window_size)
    readings, cuts = _positions(events, heads, time_range)
    if isinstance(window_size, int):
        return _rolling_rows(readings, window_size, lag_rows)
    return _rolling_time(readings, cuts, seconds, lag_rows)


def torque_rolling(events: DataFrame, window_size: int | str = 1000, heads=None, time_range=None) -> DataFrame:
    """Moving mean and deviation per head, one row per successful closure.

    An integer counts closures; text such as "7D" or "12h" is a time window.
    """
    rows = _rolling(events, window_size, heads, time_range).where(~F.col("_halo"))
    return rows.select("head_id", "timestamp", "counter", "torque_nm", "moving_avg", "moving_std")


def torque_changepoints(
    events: DataFrame, window_size: int | str = 1000, heads=None, time_range=None
) -> DataFrame:
    """Where the moving mean starts to differ from itself a short lag earlier by
    more than two deviations of the head."""
    k = _lag_rows(window_size)
    rows = _rolling(events, window_size, heads, time_range, k)
    ordered = Window.partitionBy("head_id", "_chunk").orderBy("_pos")
    shifted = rows.withColumn("shift_nm", F.abs(F.col("moving_avg") - F.lag("moving_avg", k).over(ordered)))
    jump = F.coalesce((F.col("_sd") > 0) & (F.col("shift_nm") > 2 * F.col("_sd")), F.lit(False))
    flagged = shifted.withColumn("_jump", jump)
    begins = F.col("_jump") & ~F.lag("_jump", 1, False).over(ordered)
    return (
        flagged.withColumn("_begins", begins)
        .where(F.col("_begins") & ~F.col("_halo"))
        .select("head_id", "timestamp", "shift_nm")
    )


def torque_daily_series(
    events: DataFrame, window_size: int | str = 1000, heads=None, time_range=None
) -> DataFrame:
    """Daily means of the moving statistics; days without events stay, as nulls."""
    points = torque_rolling(events, window_size, heads, time_range).dropna(subset=["moving_avg", "moving_std"])
    daily = points.groupBy("head_id", C.day("timestamp").alias("day")).agg(
        F.avg("moving_avg").alias("moving_avg"), F.avg("moving_std").alias("moving_std")
    )
    days = F.sequence(F.min("day"), F.max("day"), F.expr("interval 1 day"))
    calendar = daily.groupBy("head_id").agg(days.alias("_days")).select("head_id", F.explode("_days").alias("day"))
    return calendar.join(daily, ["head_id", "day"], "left")


def _outcomes(events: DataFrame, heads, time_range) -> DataFrame:
    """(population, torque_nm), in one pass; a closure that the table calls both
    good and rejected counts in both."""
    good = F.when(F.col("status_code") == SUCCESS_CODE, "successful")
    bad = F.when(F.col("is_reject"), "failed")
    chosen = filter_events(events, heads, time_range).where(F.col("torque_nm").isNotNull())
    return chosen.select(F.explode(F.array_compact(F.array(good, bad))).alias("population"), "torque_nm")


def torque_outcome_comparison(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    """Torque of good and of rejected closures; no rows unless both exist."""
    hist = histogram(_outcomes(events, heads, time_range), ["population"], "torque_nm")
    moments = moments_of(hist, ["population"], "torque_nm")
    medians = quantiles_of(hist, ["population"], "torque_nm", {"median": (0.5, "n")})
    pair = Window.partitionBy()  # two rows
    return (
        moments.join(medians, "population")
        .withColumn("_n", F.count(F.lit(1)).over(pair))
        .where(F.col("_n") == 2)
        .withColumn("runs_higher", F.col("mean") == F.max("mean").over(pair))
        .drop("_n")
    )


def mann_whitney(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    """U of the good closures against the rejected ones, exact over all rows."""
    sums = rank_sums(_outcomes(events, heads, time_range), "population", "torque_nm")
    pick = lambda c, p: F.max(F.when(F.col("population") == p, F.col(c)))
    one = sums.agg(
        pick("n", "successful").alias("n_successful"),
        pick("n", "failed").alias("n_failed"),
        pick("rank_sum", "successful").alias("_ranks"),
        F.max("ties").alias("ties"),
    ).where(F.col("n_successful").isNotNull() & F.col("n_failed").isNotNull())
    n1 = F.col("n_successful").cast("double")
    return one.withColumn("u_statistic", F.col("_ranks") - n1 * (n1 + 1) / 2).drop("_ranks")


def mann_whitney_test(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    u = mann_whitney(events, heads, time_range)
    tested = u.withColumn(
        "_p",
        mann_whitney_p(
            "u_statistic", F.col("n_successful").cast("double"), F.col("n_failed").cast("double"), "ties"
        ),
    )
    return tested.select(
        *u.columns, "_p.p_value", "_p.method", (F.col("_p.p_value") < SIGNIFICANCE).alias("significant")
    )
