"""Data set overview and success rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions import columns as C
from spindle.operators.filters import (
    bucket_label,
    check_choice,
    filter_events,
    outside,
    real_closures,
    spread,
    time_bucket,
)
from spindle.session import cut

GROUPINGS = ("overall", "per_head", "daily", "hourly", "per_file")


def dataset_summary(events: DataFrame) -> DataFrame:
    """One row describing the whole event table."""
    kinds = {k: C.count_if(F.col("classification") == k) for k in ("successful", "failed", "no_load", "other")}
    totals = events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.coalesce(F.sum("inferred_closure_count"), F.lit(0)).alias("total_inferred_closures"),
        F.countDistinct("head_id").alias("n_heads"),
        F.array_join(F.array_sort(F.collect_set("head_id")), ",").alias("heads"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        *[column.alias(k) for k, column in kinds.items()],
    )
    return described(totals)


def described(totals: DataFrame) -> DataFrame:
    """Counts of the whole data set with what follows from them."""
    return totals.select(
        "*",
        (F.col("total_inferred_closures") - F.col("total_events")).alias("closures_without_individual_status"),
        (C.seconds_between("start_time", "end_time") / 86400.0).alias("duration_days"),
        C.success_rate("successful", "failed").alias("overall_success_rate_pct"),
    )


def events_per_source_file(events: DataFrame) -> DataFrame:
    return events.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_events"))


def quality_flags(totals: DataFrame) -> DataFrame:
    """The warnings an overview repeats from the ingest report: one row per
    condition that holds, with its count."""
    flags = {
        "unexpected_status_codes": "unexpected_status_total",
        "schema_errors": "schema_errors",
        "boundary_gaps": "boundary_gaps",
        "counter_resets": "counter_resets_total",
        "duplicates_removed": "duplicate_events_removed_total",
    }
    listed = F.array(
        *[
            F.struct(F.lit(flag).alias("flag"), F.col(column).cast("bigint").alias("n"))
            for flag, column in flags.items()
            if column in totals.columns
        ]
    )
    return totals.select(F.inline(listed)).where(F.col("n") > 0)


def success_rate(
    events: DataFrame, group_by: str = "overall", heads=None, time_range=None
) -> DataFrame:
    """Good and bad closures per group, without no-load events.

    The rate ignores observations that are neither good nor rejected. A group
    more than two deviations below the mean of the groups is flagged; heads are
    ranked from worst to best, heads without a rate first.
    """
    check_choice("group_by", group_by, GROUPINGS)
    real = real_closures(filter_events(events, heads, time_range))
    counts = real.groupBy(time_bucket(group_by).alias("_key")).agg(
        F.count(F.lit(1)).alias("total_closures"),
        F.sum("inferred_closure_count").alias("inferred_closures"),
        C.count_if(F.col("is_successful")).alias("successful"),
        C.count_if(F.col("is_reject")).alias("failed"),
    )
    return rates(cut(counts), group_by, bucket_label(group_by, F.col("_key")))


def rates(counts: DataFrame, group_by: str, label: Column) -> DataFrame:
    """Counts per group with their rates, compared with the other groups."""
    table = counts.withColumn("success_rate_pct", C.success_rate("successful", "failed"))
    spread_of = spread(table, "success_rate_pct")
    evaluated = F.col("successful") + F.col("failed")
    result = table.withColumn("_s", spread_of).select(
        label.alias("group"),
        "total_closures",
        "inferred_closures",
        "successful",
        "failed",
        (F.col("total_closures") - evaluated).alias("other_count"),
        (F.col("inferred_closures") - F.col("total_closures")).alias("closures_without_individual_status"),
        evaluated.alias("evaluated_status_observations"),
        "success_rate_pct",
        outside(F.col("success_rate_pct"), F.col("_s"), "below").alias("flagged"),
        F.col("_s.mean").alias("avg_group_rate_pct"),
    )
    if group_by == "per_head":  # at most MAX_HEAD_IDS rows
        worst_first = Window.partitionBy().orderBy(F.col("success_rate_pct").asc_nulls_first(), "group")
        result = result.withColumn("rank_worst_to_best", F.row_number().over(worst_first))
    return result
