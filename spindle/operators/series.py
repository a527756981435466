"""The numbers behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions import columns as C
from spindle.operators.filters import (
    check_choice,
    filter_events,
    outside,
    real_closures,
    spread,
    successful_closures,
)
from spindle.operators.production import utilization
from spindle.operators.summary import success_rate
from spindle.plans.distribution import histogram, quantiles_of

BINS = 40
BAND = {"lo": 0.005, "hi": 0.995}
HEADS_SHOWN_APART = 3


def series_torque_over_time(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    """Daily mean torque of good closures. Heads are kept apart when a head
    filter leaves at most three of them, else there is one series."""
    good = successful_closures(filter_events(events, heads, time_range)).where(F.col("torque_nm").isNotNull())
    day = C.day("timestamp").alias("day")
    mean = F.avg("torque_nm").alias("mean_torque_nm")
    if not heads:
        return good.groupBy(day).agg(mean).select(F.lit("overall").alias("head_id"), "day", "mean_torque_nm")
    present = good.agg(F.countDistinct("head_id")).scalar()
    label = F.when(F.col("_present") <= HEADS_SHOWN_APART, F.col("head_id")).otherwise("overall")
    return good.withColumn("_present", present).groupBy(label.alias("head_id"), day).agg(mean)


def series_torque_histogram(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    """40 equal bins over the central 99 percent; readings outside are left out
    and the last bin includes its right edge."""
    good = histogram(successful_closures(filter_events(events, heads, time_range)), [], "torque_nm")
    band = quantiles_of(good, [], "torque_nm", {name: (p, "n") for name, p in BAND.items()})
    whole = good.agg(F.min("torque_nm").alias("least"), F.max("torque_nm").alias("most"))
    limits = band.withColumn("_w", whole.select(F.struct("least", "most")).scalar())
    flat = F.col("lo") >= F.col("hi")
    limits = limits.select(
        F.when(flat, F.col("_w.least")).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("_w.most")).otherwise(F.col("hi")).alias("hi"),
    )
    point = F.col("lo") == F.col("hi")
    edges = limits.select(
        F.when(point, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(point, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    ).where(F.col("lo").isNotNull())
    x, lo, hi = F.col("torque_nm"), F.col("_e.lo"), F.col("_e.hi")
    index = F.least(F.floor((x - lo) / (hi - lo) * BINS), F.lit(BINS - 1)).cast("int")
    counts = (
        good.withColumn("_e", edges.select(F.struct("lo", "hi")).scalar())
        .where(x.between(lo, hi))
        .groupBy(index.alias("bin"))
        .agg(F.sum("n").alias("count"))
    )
    grid = edges.select(F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"), "lo", "hi")
    width = (F.col("hi") - F.col("lo")) / BINS
    return grid.join(F.broadcast(counts), "bin", "left").select(  # 40 rows
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def series_success_per_head(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    table = success_rate(events, "per_head", heads, time_range)
    return table.select(
        F.col("group").alias("head_id"),
        "success_rate_pct",
        (F.col("success_rate_pct") - F.col("avg_group_rate_pct")).alias("deviation_from_avg_pct"),
        "rank_worst_to_best",
        "flagged",
    )


def series_failures_per_day(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    real = real_closures(filter_events(events, heads, time_range))
    daily = real.groupBy(C.day("timestamp").alias("day")).agg(C.count_if(F.col("is_reject")).alias("failures"))
    marked = daily.withColumn("_s", spread(daily, "failures"))
    return marked.select("day", "failures", outside(F.col("failures"), F.col("_s"), "above").alias("elevated"))


def series_production_per_day(events: DataFrame, heads=None, time_range=None) -> DataFrame:
    timed = real_closures(filter_events(events, heads, time_range)).where(F.col("capping_speed_pph").isNotNull())
    daily = timed.groupBy(C.day("timestamp").alias("day")).agg(F.sum("inferred_closure_count").alias("closures"))
    return daily.where(F.col("closures") > 0)


def series_utilization(idle: DataFrame, time_range=None) -> DataFrame:
    """Productive and idle share; no row without any idle interval on record."""
    share = utilization(idle, time_range).select(
        (F.col("utilization_rate") * 100.0).alias("utilization_pct"),
        ((1.0 - F.col("utilization_rate")) * 100.0).alias("idle_pct"),
    )
    on_record = idle.agg(F.count(F.lit(1))).scalar()
    return share.where(F.col("utilization_pct").isNotNull() & (on_record > 0))


SERIES = {
    "torque_over_time": series_torque_over_time,
    "torque_histogram": series_torque_histogram,
    "success_rate_per_head": series_success_per_head,
    "failures_over_time": series_failures_per_day,
    "production_over_time": series_production_per_day,
}
CHARTS = (*SERIES, "utilization", "kpi_dashboard")
DASHBOARD = ("success_rate_per_head", "torque_histogram", "production_over_time", "utilization")


def chart_series(
    events: DataFrame, idle: DataFrame | None, chart: str, heads=None, time_range=None
) -> dict[str, DataFrame]:
    """The series of one chart type, by name."""
    check_choice("chart_type", chart, CHARTS)
    found = {}
    for name in DASHBOARD if chart == "kpi_dashboard" else (chart,):
        if name != "utilization":
            found[name] = SERIES[name](events, heads, time_range)
        elif idle is not None:
            found[name] = series_utilization(idle, time_range)
    return found


def series_kpi_dashboard(events: DataFrame, idle: DataFrame, time_range=None) -> DataFrame:
    """The four dashboard series in one long table."""
    parts = chart_series(events, idle, "kpi_dashboard", None, time_range)
    shapes = {
        "success_rate_per_head": ("head_id", "success_rate_pct"),
        "torque_histogram": ("bin", "count"),
        "production_over_time": ("day", "closures"),
        "utilization": (F.lit("productive"), "utilization_pct"),
    }
    long = None
    for name, part in parts.items():
        point, value = shapes[name]
        rows = part.select(
            F.lit(name).alias("series"),
            C._col(point).cast("string").alias("point"),
            F.col(value).cast("double").alias("value"),
        )
        long = rows if long is None else long.unionAll(rows)
    return long
