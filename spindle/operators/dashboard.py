"""Key figures and the tables of the three reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.columns import status_label
from spindle.operators import anomaly, failures, heads, production, rollup, summary, torque
from spindle.operators.filters import filter_events
from spindle.session import cut

TOP_ANOMALY_HEADS = 10
TOP_VARIABILITY = 5


def _one(table: DataFrame) -> Column:
    """The only row of a table, as a struct."""
    return table.select(F.struct("*")).scalar()


def cells_of(events: DataFrame, idle: DataFrame | None = None, time_range=None, stored: DataFrame | None = None) -> DataFrame:
    """Hourly cells of a range, computed once: from stored ones, or in one pass
    over the events."""
    if stored is not None:
        return cut(rollup.cells_in(stored, events, idle, time_range))
    return cut(rollup.hourly_cells(filter_events(events, None, time_range), idle))


def kpi_dashboard(events: DataFrame, idle: DataFrame, time_range=None, cells: DataFrame | None = None) -> DataFrame:
    """One row of key figures. Only the anomalies look at single events; all other
    figures come from hourly cells, which may be stored ones of the whole table
    or, in a report, those of the range."""
    chosen = filter_events(events, None, time_range)
    cells = cells_of(events, idle, time_range, cells)
    span = cells.agg(F.min("first_time").alias("start_time"), F.max("last_time").alias("end_time"))
    window = time_range if time_range is not None else span.where(F.col("start_time").isNotNull())
    per_head = rollup.success_rate(cells, "per_head")
    order = F.col("rank_worst_to_best")
    ends = per_head.agg(
        F.min_by("group", order).alias("worst_head"),
        F.min_by("success_rate_pct", order).alias("worst_head_rate_pct"),
        F.max_by("group", order).alias("best_head"),
        F.max_by("success_rate_pct", order).alias("best_head_rate_pct"),
    )
    by_head = rollup.head_comparison(cells).agg(
        F.stddev_pop("mean_torque_nm").alias("torque_stability_std_across_heads")
    )
    parts = {
        "_rate": rollup.success_rate(cells, "overall"),
        "_ends": ends,
        "_stability": by_head,
        "_torque": rollup.mean_torque(cells),
        "_machine": rollup.machine_throughput(cells),
        "_speed": rollup.head_speed(cells),
        "_idle": production.utilization(idle, window),
        "_odd": anomaly.anomalies_total(anomaly.anomalies(chosen, "zscore", bounds=rollup.head_bounds(cells))),
    }
    row = events.sparkSession.range(1).select(*[_one(t).alias(name) for name, t in parts.items()])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return row.select(
        F.col("_rate.success_rate_pct").alias("overall_success_rate_pct"),
        zero("_rate.successful").alias("successful_status_observations"),
        zero("_rate.failed").alias("failed_status_observations"),
        "_torque.mean_torque_nm",
        "_stability.torque_stability_std_across_heads",
        F.col("_machine.mean").alias("machine_wide_throughput_pph"),
        zero("_machine.hours_with_production").alias("production_hours_with_closures"),
        F.col("_speed.mean").alias("per_head_average_speed_pph"),
        (F.col("_idle.utilization_rate") * 100.0).alias("utilization_rate_pct"),
        "_ends.worst_head",
        "_ends.worst_head_rate_pct",
        "_ends.best_head",
        "_ends.best_head_rate_pct",
        zero("_odd.total_anomalies").alias("n_anomalies"),
        (F.col("_idle.total_idle_seconds") / 3600.0).alias("total_idle_hours"),
        "_idle.observation_window_hours",
    )


def _compared(events: DataFrame, cells: DataFrame | None) -> DataFrame:
    return heads.head_comparison(events) if cells is None else rollup.head_comparison(cells)


def report_ranking(events: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Heads from best to worst success rate, with every rank."""
    table = _compared(events, cells)
    best_first = Window.partitionBy().orderBy(F.asc_nulls_last("rank_success_rate"), "head_id")
    return table.withColumn("position", F.row_number().over(best_first))


def report_kpi_findings(events: DataFrame, idle: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """The findings and scope figures of the KPI report, one row."""
    cells = cells_of(events, idle, None, cells)
    table = rollup.head_comparison(cells)
    gaps = rollup.gap_affected_hours(cells)
    scope = rollup.dataset_summary(cells).select("total_events", "n_heads", "start_time", "end_time")
    gap_figures = gaps.agg(
        F.count(F.lit(1)).alias("gap_hours"),
        F.min("hour").alias("first_gap_hour"),
        F.min_by("pieces_per_hour", "hour").alias("first_gap_pieces"),
        F.min_by("backlogged_closures", "hour").alias("first_gap_backlog"),
    )
    spread = table.agg(F.min("mean_torque_nm").alias("least_mean_torque"), F.max("mean_torque_nm").alias("most_mean_torque"))
    flagged = heads.flag_outlier_heads(table).agg(F.count(F.lit(1)).alias("n_flags"))
    idle_count = idle.agg(F.count(F.lit(1)).alias("n_idle_periods"))
    parts = [scope, gap_figures, spread, heads.busiest_quietest(table), flagged, idle_count]
    names = [f"_{i}" for i in range(len(parts))]
    row = events.sparkSession.range(1).select(*[_one(p).alias(n) for p, n in zip(parts, names)])
    return row.select(*[f"{n}.*" for n in names])


def report_anomaly_heads(events: DataFrame) -> DataFrame:
    """The heads with the most z-score anomalies; head id breaks ties."""
    return _most_anomalies(anomaly.anomalies_per_head(anomaly.anomalies(events, "zscore")))


def _most_anomalies(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("n_anomalies"), "head_id").limit(TOP_ANOMALY_HEADS)


def report_failure_codes(events: DataFrame) -> DataFrame:
    table = failures.failure_distribution(events)
    return table.withColumn("status_label", status_label("status_code"))


def report_anomaly(events: DataFrame, cells: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of the anomaly and failure report. The events are read once for
    the counts per head of anomalies, and for the bursts."""
    cells = cells_of(events, None, None, cells)
    odd = anomaly.anomalies(events, "zscore", bounds=rollup.head_bounds(cells))
    counts = cut(anomaly.anomalies_per_head(odd))
    n = F.coalesce(F.sum("n_anomalies"), F.lit(0))
    codes = rollup.failure_distribution(cells)
    return {
        "anomaly_totals": counts.agg(n.alias("total_anomalies"), F.count(F.lit(1)).alias("n_heads"), (n > anomaly.MAX_EVENTS).alias("truncated")),
        "anomaly_heads": _most_anomalies(counts),
        "hourly_spikes": rollup.hourly_failure_spikes(cells),
        "failure_codes": codes.withColumn("status_label", status_label("status_code")),
        "daily_spikes": rollup.daily_failure_spikes(cells),
        "dominant_failures": rollup.dominant_failure(cells),
        "bursts": failures.failure_bursts(events),
        "flagged_heads": heads.flag_outlier_heads(rollup.head_comparison(cells)),
    }


def report_variability(events: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """The five heads with the largest and the five with the smallest torque
    deviation, and their relative spread."""
    table = _compared(events, cells).where(F.col("std_torque_nm").isNotNull())
    down = Window.partitionBy().orderBy(F.desc("std_torque_nm"), "head_id")
    up = Window.partitionBy().orderBy(F.asc("std_torque_nm"), F.desc("head_id"))
    ranked = table.withColumns({"_top": F.row_number().over(down), "_bottom": F.row_number().over(up)})
    cv = F.col("std_torque_nm") / F.nullif(F.col("mean_torque_nm"), F.lit(0.0))

    def side(name, position):
        kept = ranked.where(F.col(position) <= TOP_VARIABILITY)
        return kept.select(
            F.lit(name).alias("side"),
            F.col(position).alias("position"),
            "head_id",
            "std_torque_nm",
            "mean_torque_nm",
            cv.alias("coefficient_of_variation"),
        )

    return side("highest", "_top").unionAll(side("lowest", "_bottom"))


def report_head_spread(events: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """How far the heads lie apart: mean torque, torque deviation and volume."""
    table = _compared(events, cells)
    percent = lambda low, high: (high - low) / F.nullif(low.cast("double"), F.lit(0.0)) * 100.0
    m, s, n = F.col("mean_torque_nm"), F.col("std_torque_nm"), F.col("total_closures")
    return table.agg(
        F.min(m).alias("least_mean"),
        F.max(m).alias("most_mean"),
        percent(F.min(m), F.max(m)).alias("mean_spread_pct"),
        F.min(s).alias("least_std"),
        F.max(s).alias("most_std"),
        (F.max(n) - F.min(n)).alias("volume_spread"),
        percent(F.min(n), F.max(n)).alias("volume_spread_pct"),
    )


def report_head_comparison(events: DataFrame, cells: DataFrame | None = None) -> dict[str, DataFrame]:
    """The events are read once, for the test of ranks."""
    cells = cells_of(events, None, None, cells)
    table = rollup.head_comparison(cells)
    return {
        "ranking": report_ranking(events, cells),
        "kruskal_wallis": heads.kruskal_wallis_test(events),
        "flagged_heads": heads.flag_outlier_heads(table),
        "variability": report_variability(events, cells),
        "spread": report_head_spread(events, cells),
        "busiest_quietest": heads.busiest_quietest(table),
    }


def report_kpi(events: DataFrame, idle: DataFrame, cells: DataFrame | None = None) -> dict[str, DataFrame]:
    """The events are read for anomalies and for the test of ranks."""
    cells = cells_of(events, idle, None, cells)
    return {
        "kpis": kpi_dashboard(events, idle, cells=cells),
        "ranking": report_ranking(events, cells),
        "findings": report_kpi_findings(events, idle, cells),
        "flagged_heads": heads.flag_outlier_heads(rollup.head_comparison(cells)),
        "kruskal_wallis": heads.kruskal_wallis_test(events),
    }


def analytics_suite(events: DataFrame, idle: DataFrame, totals: DataFrame | None = None, cells: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every analysis over one load of the tables, by name. What counts and
    averages per hour, head and status can say comes from one set of cells."""
    cells = cells_of(events, idle, None, cells)
    table = rollup.head_comparison(cells)
    odd = anomaly.anomalies(events, "zscore", bounds=rollup.head_bounds(cells))
    hours = rollup.production_hours(cells)
    span = cells.agg(F.min("first_time").alias("start_time"), F.max("last_time").alias("end_time"))
    window = span.where(F.col("start_time").isNotNull())
    suite = {
        "dataset_summary": rollup.dataset_summary(cells),
        "events_per_source_file": summary.events_per_source_file(events),
        "kpi_dashboard": kpi_dashboard(events, idle, cells=cells),
        "head_comparison": table,
        "flagged_heads": heads.flag_outlier_heads(table),
        "busiest_quietest": heads.busiest_quietest(table),
        "kruskal_wallis": heads.kruskal_wallis_test(events),
        "success_rate_correlation": heads.success_rate_correlation(events),
        "failure_breakdown": heads.failure_breakdown(events),
        "failure_distribution": rollup.failure_distribution(cells),
        "daily_failure_spikes": rollup.daily_failure_spikes(cells),
        "dominant_failure": rollup.dominant_failure(cells),
        "failure_bursts": failures.failure_bursts(events),
        "failure_correlation": rollup.failure_correlation(cells),
        "failure_by_hour_of_day": rollup.failure_by_hour_of_day(cells),
        "hour_of_day_test": failures.hour_of_day_test(events),
        "torque_trend": torque.torque_trend_significance(events),
        "torque_changepoints": torque.torque_changepoints(events),
        "torque_daily_series": torque.torque_daily_series(events),
        "anomalies": anomaly.top_anomalies(odd),
        "anomalies_per_head": anomaly.anomalies_per_head(odd),
        "hourly_failure_spikes": rollup.hourly_failure_spikes(cells),
        "machine_throughput": rollup.machine_throughput(cells),
        "machine_timeline": production.timeline_of(hours),
        "gap_affected_hours": rollup.gap_affected_hours(cells),
        "throughput_anomalies": production.throughput_anomalies_of(production.timeline_of(hours)),
        "head_speed": rollup.head_speed(cells),
        "head_speed_variability": rollup.head_speed_variability(cells),
        "utilization": production.utilization(idle, window),
        "idle_by_hour_of_day": production.idle_by_hour_of_day(idle, window),
        "longest_idle": production.longest_idle(idle, window),
    }
    if totals is not None:
        suite["quality_flags"] = summary.quality_flags(totals)
    return suite
