"""When, where and how closures are rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions import columns as C
from spindle.functions.pvalues import chi_square_p
from spindle.operators.filters import filter_events, outside, real_closures, spread
from spindle.plans.pairwise import head_pairs, pair_sums, pearson
from spindle.plans.slices import running, sliced
from spindle.session import cut

SIGNIFICANCE = 0.05


def failure_distribution(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    rejects = real_closures(filter_events(events, heads, time_range)).where(F.col("is_reject"))
    return rejects.groupBy("status_code").agg(F.count(F.lit(1)).alias("n_failures"))


def daily_failure_spikes(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    """Days whose share of rejects is two deviations above the mean day."""
    real = real_closures(filter_events(events, heads, time_range))
    counted = real.groupBy(C.day("timestamp").alias("day")).agg(
        C.count_if(F.col("is_reject")).alias("n_failures"), F.count(F.lit(1)).alias("_n")
    )
    return spikes_of(cut(counted))


def spikes_of(counted: DataFrame) -> DataFrame:
    daily = counted.select("day", "n_failures", (F.col("n_failures") / F.col("_n") * 100.0).alias("failure_rate_pct"))
    marked = daily.withColumn("_s", spread(daily, "failure_rate_pct"))
    return marked.where(outside(F.col("failure_rate_pct"), F.col("_s"), "above")).drop("_s")


def dominant_failure(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    """Each head's most frequent reject code; the lower code wins a tie."""
    rejects = real_closures(filter_events(events, heads, time_range)).where(F.col("is_reject"))
    return dominant_of(rejects.groupBy("head_id", "status_code").agg(F.count(F.lit(1)).alias("count")))


def dominant_of(profile: DataFrame) -> DataFrame:
    most = F.struct(-F.col("count"), F.col("status_code"))
    return profile.groupBy("head_id").agg(
        F.min_by("status_code", most).alias("status_code"), F.max("count").alias("count")
    ).withColumn("status_label", C.status_label("status_code"))


def failure_bursts(events: DataFrame, min_run: int = 3, heads=None, time_range=None) -> DataFrame:
    """Maximal runs of rejects of one head, in time order over its real events.

    Rejects with the same number of other events before them form one run, so a
    run is an aggregation however long it is.
    """
    real = real_closures(filter_events(events, heads, time_range)).select(
        "head_id", "timestamp", "counter", "is_reject", "status_code"
    )
    timed = sliced(real.withColumn("_at", C.micros("timestamp")), "_at")
    other = F.when(F.col("is_reject"), 0).otherwise(1)
    numbered = running(timed, ["head_id"], ["_at", "counter"], {"_run": other})
    return (
        numbered.where(F.col("is_reject"))
        .groupBy("head_id", "_run")
        .agg(
            F.min("timestamp").alias("start_time"),
            F.max("timestamp").alias("end_time"),
            F.count(F.lit(1)).alias("count"),
            F.array_sort(F.collect_set("status_code")).alias("_codes"),
        )
        .where(F.col("count") >= min_run)
        .withColumn("failure_types", F.array_join(F.col("_codes").cast("array<string>"), ","))
        .drop("_run", "_codes")
    )


def failure_correlation(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    """Do heads fail in the same hours? Pearson r of the hourly reject counts,
    where a head without rejects in an hour counts as zero."""
    real = real_closures(filter_events(events, heads, time_range))
    hourly = real.groupBy(C.hour("timestamp").alias("hour"), "head_id").agg(
        C.count_if(F.col("is_reject")).cast("double").alias("failures")
    )
    return correlated(cut(hourly))


def correlated(hourly: DataFrame) -> DataFrame:
    """Pearson r of the failures of each two heads, given those per hour and head."""
    n_hours = hourly.agg(F.countDistinct("hour").cast("double")).scalar()
    # zeros add nothing to any sum, so only hours with rejects are multiplied
    failing = hourly.where(F.col("failures") > 0)
    together = pair_sums(failing, "hour", "failures").select("head_a", "head_b", "sab")
    alone = F.broadcast(  # at most MAX_HEAD_IDS rows
        hourly.groupBy("head_id").agg(
            F.sum("failures").alias("s"), F.sum(F.col("failures") * F.col("failures")).alias("ss")
        )
    )
    a = alone.select(F.col("head_id").alias("head_a"), F.col("s").alias("sa"), F.col("ss").alias("saa"))
    b = alone.select(F.col("head_id").alias("head_b"), F.col("s").alias("sb"), F.col("ss").alias("sbb"))
    r = pearson(
        n_hours, *(F.col(c) for c in ("sa", "sb", "saa", "sbb")), F.coalesce("sab", F.lit(0.0))
    )
    return (
        head_pairs(hourly)
        .join(F.broadcast(a), "head_a")
        .join(F.broadcast(b), "head_b")
        .join(together, ["head_a", "head_b"], "left")
        .select("head_a", "head_b", F.bround(r, 3).alias("correlation"))
    )


def failure_by_hour_of_day(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    """Always 24 rows; an hour without events has no rate."""
    real = real_closures(filter_events(events, heads, time_range))
    counted = real.groupBy(F.hour("timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("n_events"), C.count_if(F.col("is_reject")).alias("n_failures")
    )
    return all_hours(counted)


def all_hours(counted: DataFrame) -> DataFrame:
    hours = counted.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return (
        hours.join(F.broadcast(counted), "hour", "left")
        .na.fill(0, ["n_events", "n_failures"])
        .withColumn("failure_rate_pct", C.ratio(F.col("n_failures") * 100.0, "n_events"))
    )


def hour_of_day_chi2(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    """Independence of hour and outcome over the populated hours, with Yates'
    correction for two of them. No row without two hours and both outcomes."""
    table = failure_by_hour_of_day(events, heads, time_range).where(F.col("n_events") > 0)
    everything = Window.partitionBy()  # at most 24 rows
    n = F.sum("n_events").over(everything).cast("double")
    failed = F.sum("n_failures").over(everything).cast("double")
    hours = F.count(F.lit(1)).over(everything)
    cells = table.withColumns({"_n": n, "_f": failed, "_k": hours})

    def cell(observed, total):
        expected = F.col("n_events") * total / F.col("_n")
        off = F.abs(observed - expected)
        off = F.when(F.col("_k") == 2, off - F.least(F.lit(0.5), off)).otherwise(off)
        return off * off / F.nullif(expected, F.lit(0.0))

    good = F.col("n_events") - F.col("n_failures")
    chi2 = cell(F.col("n_failures"), F.col("_f")) + cell(good, F.col("_n") - F.col("_f"))
    rate = F.col("failure_rate_pct")
    return (
        cells.agg(
            F.sum(chi2).alias("chi2"),
            F.count(F.lit(1)).alias("n_hours"),
            F.min_by("hour", F.struct(-rate, F.col("hour"))).alias("peak_hour"),
            F.max(rate).alias("peak_failure_rate_pct"),
            F.min_by("hour", F.struct(rate, F.col("hour"))).alias("lowest_hour"),
            F.min(rate).alias("lowest_failure_rate_pct"),
            F.max("_f").alias("_f"),
            F.max("_n").alias("_n"),
        )
        .where((F.col("n_hours") >= 2) & (F.col("_f") > 0) & (F.col("_f") < F.col("_n")))
        .drop("_f", "_n")
    )


def hour_of_day_test(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    chi2 = hour_of_day_chi2(events, heads, time_range)
    return chi2.withColumn(
        "p_value", chi_square_p("chi2", (F.col("n_hours") - 1).cast("double"))
    ).withColumn("significant", F.col("p_value") < SIGNIFICANCE)


def failure_summary(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    rejects = real_closures(filter_events(events, heads, time_range)).where(F.col("is_reject"))
    return rejects.agg(F.count(F.lit(1)).alias("n_failures"), F.countDistinct("head_id").alias("n_heads"))
