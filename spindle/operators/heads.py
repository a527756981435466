"""Heads compared with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.constants import IDLE_CODE
from spindle.functions import columns as C
from spindle.functions.pvalues import chi_square_p, correlation_p
from spindle.operators.filters import filter_events, outside, real_closures, successful_closures
from spindle.plans.distribution import rank_sums
from spindle.plans.pairwise import head_pairs, pair_sums, pearson
from spindle.plans.sampling import sample_per_group

SIGNIFICANCE = 0.05
OUTLIER_METRICS = ("success_rate_pct", "mean_torque_nm", "std_torque_nm")
WEAK, MODERATE = 0.3, 0.7
SAMPLE, SEED = 50_000, 42  # of a test on a sample


def head_comparison(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    """One row per head. `total_closures` counts every event, no-load included;
    the other figures leave no-load out."""
    real = F.col("status_code") != IDLE_CODE
    good_torque = F.when(F.col("is_successful"), F.col("torque_nm"))
    has_real = F.count(F.when(real, 1)) > 0
    table = (
        filter_events(events, heads, time_range)
        .groupBy("head_id")
        .agg(
            F.count(F.lit(1)).alias("total_closures"),
            F.when(has_real, C.count_if(real & F.col("is_successful"))).alias("successful"),
            F.when(has_real, C.count_if(real & F.col("is_reject"))).alias("failed"),
            F.avg(good_torque).alias("mean_torque_nm"),
            F.stddev_samp(good_torque).alias("std_torque_nm"),
        )
    )
    return compared(table)


def compared(table: DataFrame) -> DataFrame:
    """Counts and torque per head with the success rate and the ranks."""
    table = table.withColumn("success_rate_pct", C.success_rate("successful", "failed"))

    def rank(column):  # at most MAX_HEAD_IDS rows
        best_first = Window.partitionBy().orderBy(F.desc_nulls_last(column))
        return F.when(F.col(column).isNotNull(), F.rank().over(best_first))

    return table.withColumns(
        {
            "rank_success_rate": rank("success_rate_pct"),
            "rank_mean_torque": rank("mean_torque_nm"),
            "rank_torque_std": rank("std_torque_nm"),
            "rank_total_closures": rank("total_closures"),
        }
    )


def flag_outlier_heads(table: DataFrame) -> DataFrame:
    """Heads more than two deviations from the group on any metric."""
    long = table.unpivot("head_id", list(OUTLIER_METRICS), "metric", "value")
    group = Window.partitionBy("metric")
    moments = F.struct(
        F.avg("value").over(group).alias("mean"),
        F.stddev_pop("value").over(group).alias("sd"),
        F.count("value").over(group).alias("n"),
    )
    marked = long.withColumn("_s", moments).where(outside(F.col("value"), F.col("_s"), "both"))
    return marked.select(
        "head_id",
        "metric",
        "value",
        F.col("_s.mean").alias("group_avg"),
        F.when(F.col("value") > F.col("_s.mean"), "higher").otherwise("lower").alias("direction"),
    )


def busiest_quietest(table: DataFrame) -> DataFrame:
    """The heads with most and fewest closures; the first head id wins a tie."""
    n = F.col("total_closures")
    return table.agg(
        F.min_by("head_id", F.struct(-n, F.col("head_id"))).alias("busiest_head"),
        F.max(n).alias("busiest_closures"),
        F.min_by("head_id", F.struct(n, F.col("head_id"))).alias("quietest_head"),
        F.min(n).alias("quietest_closures"),
    ).where(F.col("busiest_head").isNotNull())


def sample_per_head(events: DataFrame, size: int = SAMPLE, seed: int = SEED, heads=None, time_range=None) -> DataFrame:
    """At most `size` successful closures with a torque of each head, drawn
    without replacement: the same for a seed, however the events are stored."""
    good = successful_closures(filter_events(events, heads, time_range)).where(F.col("torque_nm").isNotNull())
    key = F.concat_ws(":", F.unix_micros(F.col("timestamp").cast("timestamp")).cast("string"), F.col("counter").cast("string"))
    return sample_per_group(good, "head_id", size, key, seed)


def kruskal_wallis(events: DataFrame, heads=None, time_range=None, sample: int | None = None, seed: int = SEED) -> DataFrame:
    """H over all successful torque readings, corrected for ties. One row, or
    none with fewer than two heads. With `sample`, over so many of each head."""
    if sample is None:
        good = successful_closures(filter_events(events, heads, time_range))
    else:
        good = sample_per_head(events, sample, seed, heads, time_range)
    sums = rank_sums(good, "head_id", "torque_nm")
    n, n_all = F.col("n").cast("double"), F.col("n_all").cast("double")
    off_centre = F.pow(F.col("rank_sum") / n - (n_all + 1) / 2, 2)
    total = F.max(n_all)
    raw = F.sum(n * off_centre) * F.lit(12.0) / (total * (total + 1))
    tie_factor = F.lit(1.0) - F.max("ties") / F.nullif(F.pow(total, 3) - total, F.lit(0.0))
    return sums.agg(
        (raw / F.nullif(tie_factor, F.lit(0.0))).alias("h_statistic"),
        F.count(F.lit(1)).alias("n_groups"),
        F.max("n_all").alias("n_observations"),
    ).where(F.col("n_groups") >= 2)


def kruskal_wallis_test(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    h = kruskal_wallis(events, heads, time_range)
    return h.withColumn(
        "p_value", chi_square_p("h_statistic", (F.col("n_groups") - 1).cast("double"))
    ).withColumn("significant", F.col("p_value") < SIGNIFICANCE)


def success_rate_correlation(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    """Do heads have their good and bad days together? Pearson r of the daily
    success rates over the days both heads have one."""
    real = real_closures(filter_events(events, heads, time_range))
    daily = real.groupBy(C.day("timestamp").alias("day"), "head_id").agg(
        C.count_if(F.col("is_successful")).alias("_good"), C.count_if(F.col("is_reject")).alias("_bad")
    )
    rates = daily.withColumn("rate", C.ratio("_good", F.col("_good") + F.col("_bad")))
    lowest = F.broadcast(rates.groupBy("head_id").agg(F.min("rate").alias("_low")))  # MAX_HEAD_IDS rows
    cells = rates.where(F.col("rate").isNotNull()).join(lowest, "head_id")
    sums = pair_sums(cells.withColumn("_x", F.col("rate") - F.col("_low")), "day", "_x")
    r = pearson(*(F.col(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")))
    return head_pairs(daily).join(sums, ["head_a", "head_b"], "left").select(
        "head_a", "head_b", F.bround(r, 3).alias("correlation")
    )


def failure_breakdown(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    rejects = filter_events(events, heads, time_range).where(F.col("is_reject"))
    return (
        rejects.groupBy("head_id", "status_code")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("status_label", C.status_label("status_code"))
    )


def head_torque_and_rate(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    table = head_comparison(events, heads, time_range)
    return table.select("head_id", "mean_torque_nm", "success_rate_pct").dropna()


def torque_success_correlation(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    """Pearson r between mean torque and success rate over the heads; no row
    with fewer than three heads, null without variation."""
    table = head_torque_and_rate(events, heads, time_range)
    x, y = "mean_torque_nm", "success_rate_pct"
    spread_xy = F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))
    r = F.col("pearson_r")
    return (
        table.agg((F.covar_samp(x, y) / spread_xy).alias("pearson_r"), F.count(F.lit(1)).alias("n_heads"))
        .where(F.col("n_heads") >= 3)
        .withColumns(
            {
                "strength": F.when(F.abs(r) < WEAK, "weak")
                .when(F.abs(r) < MODERATE, "moderate")
                .when(r.isNotNull(), "strong"),
                "direction": F.when(r > 0, "positive").when(r.isNotNull(), "negative"),
            }
        )
    )


def torque_success_correlation_test(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    found = torque_success_correlation(events, heads, time_range)
    return found.withColumn(
        "p_value", correlation_p("pearson_r", F.col("n_heads").cast("double"))
    ).withColumn("significant", F.col("p_value") < SIGNIFICANCE)
