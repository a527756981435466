"""Registered queries: filters, analyses, series and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindle.catalog.oracle_views import HEADS, IDLE, PRODUCED, TELE, label
from spindle.catalog.registry import ORACLE, QUERIES, register, rounded
from spindle.operators import (
    anomaly,
    dashboard,
    failures,
    filters,
    heads,
    listing,
    production,
    quality,
    rollup,
    series,
    sketches,
    summary,
    torque,
)
from spindle.operators.events import dedupe_events, derive_speed, duplicates_removed, enrich_status
from spindle.functions.columns import format_percentage
from spindle.sources import samples
from spindle.sources.tables import stored

WEEK = ("2024-01-08 00:00:00", "2024-01-14 23:59:59")
WEEK_SQL = "\"timestamp\" BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-14 23:59:59'"
SOME_HEADS = ["H02", "H05", "H07", "H11", "H23"]
SOME_SQL = "head_id IN ('H02', 'H05', 'H07', 'H11', 'H23')"
TRIO = ["H03", "H07", "H12"]
EVENT = (
    '"timestamp", head_id, head_number, counter, counter_delta, inferred_closure_count, data_quality, torque_nm,'
    " status_code, status_label, is_reject, is_successful, classification, source_file, time_since_last_closure,"
    " capping_speed_pph"
)
EVENT_DOUBLES = "torque_nm time_since_last_closure capping_speed_pph"

events = samples.closure_events
idle = samples.idle_intervals


def on_events(operator, *args, **options):
    return lambda spark, folder: operator(events(spark, folder), *args, **options)


def on_idle(operator, *args, **options):
    return lambda spark, folder: operator(idle(spark, folder), *args, **options)


def on_production(operator):
    return lambda spark, folder: operator(production.production(events(spark, folder), idle(spark, folder)))


def on_both(operator, *args):
    return lambda spark, folder: operator(events(spark, folder), idle(spark, folder), *args)


# --- event reconstruction on top of increments ---------------------------------

register(
    "enrich_status",
    lambda s, d: enrich_status(samples.event_block(s, d)),
    TELE,
    "SELECT * FROM enriched",
    "torque_nm",
)


def _repeated(spark, folder):
    """Increments with a coarser counter, so that many repeat."""
    return samples.event_block(spark, folder).withColumn("counter", F.floor(F.col("counter") / 40))


_REPEATED = TELE + ", repeated AS (SELECT * REPLACE (counter // 40 AS counter) FROM block)"
register(
    "dedupe_events",
    lambda s, d: dedupe_events(_repeated(s, d)),
    _REPEATED,
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
         PARTITION BY head_id, segment_id, counter ORDER BY "timestamp", source_file) AS rn FROM repeated) WHERE rn = 1""",
    "torque_nm",
)
register(
    "duplicates_removed",
    lambda s, d: duplicates_removed(_repeated(s, d)),
    _REPEATED,
    """SELECT head_id, CAST(sum(n - 1) AS BIGINT) AS removed FROM
         (SELECT head_id, count(*) AS n FROM repeated GROUP BY head_id, segment_id, counter)
       GROUP BY head_id HAVING sum(n - 1) > 0""",
)
register(
    "derive_speed",
    lambda s, d: derive_speed(samples.enriched_events(s, d)).select(
        "timestamp", "head_id", "counter", "time_since_last_closure", "capping_speed_pph"
    ),
    TELE,
    'SELECT "timestamp", head_id, counter, time_since_last_closure, capping_speed_pph FROM tele',
    "time_since_last_closure capping_speed_pph",
)

# --- filters ---------------------------------------------------------------------

register(
    "filter_events",
    on_events(filters.filter_events, SOME_HEADS, WEEK),
    TELE,
    f"SELECT {EVENT} FROM tele WHERE {SOME_SQL} AND {WEEK_SQL}",
    EVENT_DOUBLES,
)
register("real_closures", on_events(filters.real_closures), TELE, f"SELECT {EVENT} FROM real", EVENT_DOUBLES)
register("successful_closures", on_events(filters.successful_closures), TELE, f"SELECT {EVENT} FROM good", EVENT_DOUBLES)
register(
    "failed_closures",
    on_events(filters.failed_closures),
    TELE,
    f"SELECT {EVENT} FROM tele WHERE is_reject",
    EVENT_DOUBLES,
)
for kind, condition in {
    "successful_only": "status_code = 0",
    "failed_only": "is_reject",
    "all_real": "status_code <> 2",
    "all": "true",
}.items():
    register(
        f"status_population_{kind}",
        lambda s, d, kind=kind: filters.status_population(events(s, d), kind)
        .groupBy("head_id")
        .agg(F.count("*").alias("n"), F.sum("torque_nm").alias("torque")),
        TELE,
        f"SELECT head_id, count(*) AS n, sum(torque_nm) AS torque FROM tele WHERE {condition} GROUP BY head_id",
        "torque",
    )
register(
    "effective_time_range",
    on_events(filters.effective_time_range),
    TELE,
    'SELECT min("timestamp") AS start_time, max("timestamp") AS end_time FROM tele',
)
register(
    "time_presets",
    on_events(filters.time_presets),
    TELE
    + """, span AS (SELECT min("timestamp") AS a, max("timestamp") AS z FROM tele),
months AS (SELECT unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH)) AS m, a, z FROM span)""",
    """SELECT '7d' AS key, 'Last 7 days' AS label, z - INTERVAL 7 DAY AS range_start, z AS range_end FROM span
       UNION ALL SELECT '30d', 'Last 30 days', z - INTERVAL 30 DAY, z FROM span
       UNION ALL SELECT 'full', 'Full Dataset', NULL, NULL FROM span
       UNION ALL SELECT 'm' || CAST(row_number() OVER (ORDER BY m) - 1 AS VARCHAR), strftime(m, '%B'),
         greatest(CAST(m AS TIMESTAMP), a), least(CAST(m AS TIMESTAMP) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND, z) FROM months""",
)
BUCKETS = {
    "overall": "'overall'",
    "per_head": "head_id",
    "daily": "strftime(date_trunc('day', \"timestamp\"), '%Y-%m-%d %H:%M:%S')",
    "hourly": "strftime(date_trunc('hour', \"timestamp\"), '%Y-%m-%d %H:%M:%S')",
    "per_file": "source_file",
}
for grid, key in BUCKETS.items():
    register(
        f"time_buckets_{grid}",
        lambda s, d, grid=grid: events(s, d)
        .groupBy(filters.bucket_label(grid, filters.time_bucket(grid)).alias("bucket"))
        .agg(F.count("*").alias("n")),
        TELE,
        f"SELECT {key} AS bucket, count(*) AS n FROM tele GROUP BY 1",
    )

# --- overview and success rates ----------------------------------------------------

register(
    "dataset_summary",
    on_events(summary.dataset_summary),
    TELE,
    """SELECT *, total_inferred_closures - total_events AS closures_without_individual_status,
         (epoch_us(end_time) - epoch_us(start_time)) / 1e6 / 86400.0 AS duration_days,
         successful * 100.0 / nullif(successful + failed, 0) AS overall_success_rate_pct
       FROM (SELECT count(*) AS total_events, CAST(sum(inferred_closure_count) AS BIGINT) AS total_inferred_closures,
         count(DISTINCT head_id) AS n_heads, array_to_string(list_sort(list(DISTINCT head_id)), ',') AS heads,
         min("timestamp") AS start_time, max("timestamp") AS end_time,
         count(*) FILTER (WHERE classification = 'successful') AS successful,
         count(*) FILTER (WHERE classification = 'failed') AS failed,
         count(*) FILTER (WHERE classification = 'no_load') AS no_load,
         count(*) FILTER (WHERE classification = 'other') AS other FROM tele)""",
    "duration_days overall_success_rate_pct",
)
register(
    "events_per_source_file",
    on_events(summary.events_per_source_file),
    TELE,
    "SELECT source_file, count(*) AS n_events FROM tele GROUP BY source_file",
)


def _rate_sql(key: str, where: str = "true", rank: bool = False) -> str:
    extra = (
        ", CAST(row_number() OVER (ORDER BY success_rate_pct ASC NULLS FIRST, \"group\") AS INTEGER) AS rank_worst_to_best"
        if rank
        else ""
    )
    return f"""SELECT "group", total_closures, inferred_closures, successful, failed,
         total_closures - successful - failed AS other_count,
         inferred_closures - total_closures AS closures_without_individual_status,
         successful + failed AS evaluated_status_observations, success_rate_pct,
         coalesce(n >= 2 AND sd > 0 AND success_rate_pct < m - 2 * sd, false) AS flagged, m AS avg_group_rate_pct{extra}
       FROM (SELECT *, avg(success_rate_pct) OVER () AS m, stddev_pop(success_rate_pct) OVER () AS sd,
           count(success_rate_pct) OVER () AS n
         FROM (SELECT *, successful * 100.0 / nullif(successful + failed, 0) AS success_rate_pct
           FROM (SELECT {key} AS "group", count(*) AS total_closures,
               CAST(sum(inferred_closure_count) AS BIGINT) AS inferred_closures,
               count(*) FILTER (WHERE is_successful) AS successful, count(*) FILTER (WHERE is_reject) AS failed
             FROM real WHERE {where} GROUP BY 1)))"""


for grid, key in BUCKETS.items():
    register(
        f"success_rate_{grid}",
        on_events(summary.success_rate, grid),
        TELE,
        _rate_sql(key, rank=grid == "per_head"),
        "success_rate_pct avg_group_rate_pct",
    )
register(
    "success_rate_filtered",
    on_events(summary.success_rate, "per_head", SOME_HEADS, WEEK),
    TELE,
    _rate_sql("head_id", f"{SOME_SQL} AND {WEEK_SQL}", rank=True),
    "success_rate_pct avg_group_rate_pct",
)
register(
    "format_percentage",
    lambda s, d: summary.success_rate(events(s, d), "hourly").select(
        "group", format_percentage("success_rate_pct").alias("text")
    ),
    TELE,
    f"""SELECT "group", CASE WHEN success_rate_pct IS NULL THEN 'n/a'
          WHEN (success_rate_pct > 0 AND success_rate_pct < 0.01) OR (success_rate_pct > 99.99 AND success_rate_pct < 100)
          THEN format('{{:.4f}}%', success_rate_pct) ELSE format('{{:.2f}}%', success_rate_pct) END AS text
        FROM ({_rate_sql(BUCKETS["hourly"])})""",
)

# --- torque -------------------------------------------------------------------------


def _torque_sql(key: str, where: str, flag: bool = False) -> str:
    flagged = "coalesce(n >= 2 AND sd > 0 AND coefficient_of_variation > m + 2 * sd, false)" if flag else "false"
    return f"""SELECT * EXCLUDE (m, sd, n), {flagged} AS flagged_high_variability
       FROM (SELECT *, avg(coefficient_of_variation) OVER () AS m, stddev_pop(coefficient_of_variation) OVER () AS sd,
           count(coefficient_of_variation) OVER () AS n
         FROM (SELECT a.*, q1, median, q3, q3 - q1 AS iqr, outlier_count, std / nullif(mean, 0) AS coefficient_of_variation
           FROM (SELECT {key} AS "group", count(torque_nm) AS count, avg(torque_nm) AS mean,
               stddev_samp(torque_nm) AS std, min(torque_nm) AS min, max(torque_nm) AS max
             FROM tele WHERE {where} GROUP BY 1) a
           JOIN (SELECT g AS "group", q1, median, q3,
               count(*) FILTER (WHERE torque_nm < q1 - 1.5 * (q3 - q1) OR torque_nm > q3 + 1.5 * (q3 - q1)) AS outlier_count
             FROM (SELECT g, torque_nm, quantile_cont(torque_nm, 0.25) OVER (PARTITION BY g) AS q1,
                 quantile_cont(torque_nm, 0.5) OVER (PARTITION BY g) AS median,
                 quantile_cont(torque_nm, 0.75) OVER (PARTITION BY g) AS q3
               FROM (SELECT {key} AS g, torque_nm FROM tele WHERE {where}))
             GROUP BY ALL) b USING ("group")))"""


_TORQUE_DOUBLES = "mean std min max q1 median q3 iqr coefficient_of_variation"
for grid in torque.GROUPINGS:
    register(
        f"torque_statistics_{grid}",
        on_events(torque.torque_statistics, "successful_only", grid),
        TELE,
        _torque_sql(BUCKETS[grid], "status_code = 0", grid == "per_head"),
        _TORQUE_DOUBLES,
    )
for population, condition in {"failed_only": "is_reject", "all_real": "status_code <> 2", "all": "true"}.items():
    register(
        f"torque_statistics_{population}",
        on_events(torque.torque_statistics, population, "per_head"),
        TELE,
        _torque_sql("head_id", condition, True),
        _TORQUE_DOUBLES,
    )
_DAYS = TELE + ", dated AS (SELECT *, epoch_us(\"timestamp\") / 86400000000.0 AS days FROM good)"
_TREND = """SELECT head_id, regr_slope(torque_nm, days - 19723) AS slope_nm_per_day,
    regr_r2(torque_nm, days - 19723) AS r_squared, count(*) AS n_events FROM dated GROUP BY head_id HAVING count(*) >= 2"""
register("torque_trend", on_events(torque.torque_trend), _DAYS, _TREND, "slope_nm_per_day r_squared")
register("torque_trend_significance", on_events(torque.torque_trend_significance))
register("torque_trend_summary", on_events(torque.torque_trend_summary))


def _rolling_views(rows: int | None, interval: str = "") -> str:
    if rows:
        frame = f"ORDER BY \"timestamp\", counter ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW"
        least = max(2, rows // 10)
    else:
        frame = f"ORDER BY epoch_us(\"timestamp\") RANGE BETWEEN {interval} PRECEDING AND CURRENT ROW"
        least = 1
    return (
        TELE
        + f""", rolling AS (
  SELECT head_id, "timestamp", counter, torque_nm,
    CASE WHEN count(torque_nm) OVER w >= {least} THEN avg(torque_nm) OVER w END AS moving_avg,
    CASE WHEN count(torque_nm) OVER w >= {max(2, least)} THEN stddev_samp(torque_nm) OVER w END AS moving_std,
    stddev_samp(torque_nm) OVER (PARTITION BY head_id) AS sd
  FROM good WINDOW w AS (PARTITION BY head_id {frame}))"""
    )


def _changepoint_sql(lag: int) -> str:
    return f"""SELECT head_id, "timestamp", shift_nm FROM
      (SELECT *, coalesce(lag(jump) OVER (PARTITION BY head_id ORDER BY "timestamp", counter), false) AS before
       FROM (SELECT *, coalesce(sd > 0 AND shift_nm > 2 * sd, false) AS jump
         FROM (SELECT *, abs(moving_avg - lag(moving_avg, {lag}) OVER (PARTITION BY head_id ORDER BY "timestamp", counter)) AS shift_nm
           FROM rolling))) WHERE jump AND NOT before"""


_DAILY_SERIES = """SELECT g.head_id, g.day, moving_avg, moving_std
  FROM (SELECT head_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS TIMESTAMP) AS day FROM daily GROUP BY head_id) g
  LEFT JOIN daily d ON g.head_id = d.head_id AND g.day = d.day"""
_DAILY = """, daily AS (SELECT head_id, date_trunc('day', "timestamp")::TIMESTAMP AS day, avg(moving_avg) AS moving_avg, avg(moving_std) AS moving_std
  FROM rolling WHERE moving_avg IS NOT NULL AND moving_std IS NOT NULL GROUP BY 1, 2)"""
_MICROS_PER_DAY = 86_400_000_000
for name, window, views, lag in [
    ("rows", 20, _rolling_views(20), 10),
    ("time", "2D", _rolling_views(None, str(2 * _MICROS_PER_DAY - 1)), 10),
]:
    register(
        f"torque_rolling_{name}",
        on_events(torque.torque_rolling, window),
        views,
        'SELECT head_id, "timestamp", counter, torque_nm, moving_avg, moving_std FROM rolling',
        "torque_nm moving_avg moving_std",
    )
    register(
        f"torque_daily_series_{name}",
        on_events(torque.torque_daily_series, window),
        views + _DAILY,
        _DAILY_SERIES,
        "moving_avg moving_std",
    )
    register(f"torque_changepoints_{name}", on_events(torque.torque_changepoints, window), views, _changepoint_sql(lag), "shift_nm")
_OUTCOMES = TELE + """, both_outcomes AS (
  SELECT 'successful' AS population, torque_nm FROM good WHERE torque_nm IS NOT NULL
  UNION ALL SELECT 'failed', torque_nm FROM tele WHERE is_reject AND torque_nm IS NOT NULL)"""
register(
    "torque_outcome_comparison",
    on_events(torque.torque_outcome_comparison),
    _OUTCOMES,
    """SELECT population, count, mean, std, min, max, median, mean = max(mean) OVER () AS runs_higher
       FROM (SELECT population, count(*) AS count, avg(torque_nm) AS mean, stddev_samp(torque_nm) AS std,
         min(torque_nm) AS min, max(torque_nm) AS max, quantile_cont(torque_nm, 0.5) AS median
         FROM both_outcomes GROUP BY population) QUALIFY count(*) OVER () = 2""",
    "mean std min max median",
)
_RANKS = """, ranks AS (SELECT {group} AS g, rank() OVER (ORDER BY torque_nm) + (count(*) OVER (PARTITION BY torque_nm) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY torque_nm) AS t FROM {source} WHERE torque_nm IS NOT NULL)"""
register(
    "mann_whitney",
    on_events(torque.mann_whitney),
    _OUTCOMES + _RANKS.format(group="population", source="both_outcomes"),
    """SELECT n_successful, n_failed, ties, ranksum - CAST(n_successful AS DOUBLE) * (n_successful + 1) / 2 AS u_statistic
       FROM (SELECT count(*) FILTER (WHERE g = 'successful') AS n_successful, count(*) FILTER (WHERE g = 'failed') AS n_failed,
         sum(CAST(t AS DOUBLE) * t - 1) AS ties, sum(r) FILTER (WHERE g = 'successful') AS ranksum FROM ranks)
       WHERE n_successful > 0 AND n_failed > 0""",
    "ties u_statistic",
)
register("mann_whitney_test", on_events(torque.mann_whitney_test))

# --- anomalies ------------------------------------------------------------------------

_BOUNDS = {
    "zscore": """SELECT head_id, avg(torque_nm) - 3.0 * stddev_samp(torque_nm) AS lower,
        avg(torque_nm) + 3.0 * stddev_samp(torque_nm) AS upper FROM good GROUP BY head_id""",
    "iqr": """SELECT head_id, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM
        (SELECT head_id, quantile_cont(torque_nm, 0.25) AS q1, quantile_cont(torque_nm, 0.75) AS q3 FROM good GROUP BY head_id)""",
}
_RANGE = (1.0, 150.0)


def _odd_views(method: str) -> str:
    if method == "threshold":
        source = f"SELECT *, CAST({_RANGE[0]} AS DOUBLE) AS lower, CAST({_RANGE[1]} AS DOUBLE) AS upper FROM real"
    else:
        source = f"SELECT r.*, lower, upper FROM real r JOIN ({_BOUNDS[method]}) b USING (head_id)"
    return TELE + f""", odd AS (SELECT *, greatest(lower - torque_nm, torque_nm - upper) AS deviation
  FROM ({source}) WHERE torque_nm < lower OR torque_nm > upper)"""


for method in anomaly.METHODS:
    limits = {"threshold_range": _RANGE} if method == "threshold" else {}
    flag = lambda s, d, method=method, limits=limits: anomaly.anomalies(events(s, d), method, **limits)
    views = _odd_views(method)
    register(
        f"anomalies_{method}",
        lambda s, d, flag=flag: flag(s, d).select("timestamp", "head_id", "torque_nm", "lower", "upper", "deviation"),
        views,
        'SELECT "timestamp", head_id, torque_nm, lower, upper, deviation FROM odd',
        "torque_nm lower upper deviation",
    )
    register(
        f"top_anomalies_{method}",
        lambda s, d, flag=flag: anomaly.top_anomalies(flag(s, d)).drop("reason"),
        views,
        'SELECT "timestamp", head_id, torque_nm, status_code, deviation FROM odd ORDER BY deviation DESC, "timestamp", head_id, counter LIMIT 500',
        "torque_nm deviation",
    )
    register(
        f"anomalies_per_head_{method}",
        lambda s, d, flag=flag: anomaly.anomalies_per_head(flag(s, d)),
        views,
        "SELECT head_id, count(*) AS n_anomalies FROM odd GROUP BY head_id",
    )
    register(
        f"anomalies_total_{method}",
        lambda s, d, flag=flag: anomaly.anomalies_total(flag(s, d)),
        views,
        "SELECT count(*) AS total_anomalies, count(DISTINCT head_id) AS n_heads, count(*) > 500 AS truncated FROM odd",
    )
register("anomaly_reasons", lambda s, d: anomaly.top_anomalies(anomaly.anomalies(events(s, d))))
_SPIKES = "n >= 2 AND sd > 0 AND {value} > m + 2 * sd"
register(
    "hourly_failure_spikes",
    on_events(anomaly.hourly_failure_spikes),
    TELE,
    f"""SELECT hour_start, failure_rate, n_events FROM
      (SELECT *, avg(failure_rate) OVER () AS m, stddev_pop(failure_rate) OVER () AS sd, count(*) OVER () AS n
       FROM (SELECT date_trunc('hour', "timestamp")::TIMESTAMP AS hour_start, avg(CAST(is_reject AS INTEGER)) AS failure_rate,
         count(*) AS n_events FROM real GROUP BY 1)) WHERE {_SPIKES.format(value='failure_rate')}""",
    "failure_rate",
)

# --- heads ----------------------------------------------------------------------------

_HEAD_COLUMNS = "*"
_HEAD_DOUBLES = "mean_torque_nm std_torque_nm success_rate_pct"
register("head_comparison", on_events(heads.head_comparison), HEADS, "SELECT * FROM ranked", _HEAD_DOUBLES)
register(
    "flag_outlier_heads",
    lambda s, d: heads.flag_outlier_heads(heads.head_comparison(events(s, d))),
    HEADS,
    "SELECT * FROM flagged",
    "value group_avg",
)
_BUSIEST = """SELECT (SELECT head_id FROM compared ORDER BY total_closures DESC, head_id LIMIT 1) AS busiest_head,
    max(total_closures) AS busiest_closures,
    (SELECT head_id FROM compared ORDER BY total_closures, head_id LIMIT 1) AS quietest_head,
    min(total_closures) AS quietest_closures FROM compared"""
register(
    "busiest_quietest",
    lambda s, d: heads.busiest_quietest(heads.head_comparison(events(s, d))),
    HEADS,
    _BUSIEST,
)
register(
    "kruskal_wallis",
    on_events(heads.kruskal_wallis),
    TELE + _RANKS.format(group="head_id", source="good"),
    """SELECT h / (1 - ties / (CAST(n AS DOUBLE) * n * n - n)) AS h_statistic, n_groups, n AS n_observations FROM
       (SELECT 12.0 / (CAST(any_value(n) AS DOUBLE) * (any_value(n) + 1)) * sum(k * pow(mean_rank - (n + 1) / 2.0, 2)) AS h,
         count(*) AS n_groups, any_value(n) AS n, any_value(ties) AS ties
        FROM (SELECT g, count(*) AS k, avg(r) AS mean_rank, (SELECT count(*) FROM ranks) AS n,
          (SELECT sum(CAST(t AS DOUBLE) * t - 1) FROM ranks) AS ties FROM ranks GROUP BY g))
       WHERE n_groups >= 2""",
    "h_statistic",
)
register("kruskal_wallis_test", on_events(heads.kruskal_wallis_test))
_CORRELATE = """SELECT h1.head_id AS head_a, h2.head_id AS head_b, round_even(r, 3) AS correlation
    FROM {heads} h1 CROSS JOIN {heads} h2 LEFT JOIN
    (SELECT a.head_id AS x, b.head_id AS y, covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0) AS r
     FROM {cells} a JOIN {cells} b USING (bucket) GROUP BY 1, 2) ON x = h1.head_id AND y = h2.head_id
    WHERE (SELECT count(*) FROM {heads}) >= 2"""
register(
    "success_rate_correlation",
    on_events(heads.success_rate_correlation),
    TELE
    + """, daily_rates AS (SELECT date_trunc('day', "timestamp") AS bucket, head_id,
    CAST(count(*) FILTER (WHERE is_successful) AS DOUBLE) / nullif(count(*) FILTER (WHERE is_successful OR is_reject), 0) AS v
  FROM real GROUP BY 1, 2),
cells AS (SELECT * FROM daily_rates WHERE v IS NOT NULL),
some_heads AS (SELECT DISTINCT head_id FROM daily_rates)""",
    _CORRELATE.format(heads="some_heads", cells="cells"),
    "correlation",
)
register(
    "failure_breakdown",
    on_events(heads.failure_breakdown),
    TELE,
    f"""SELECT head_id, status_code, count(*) AS count, {label('status_code')} AS status_label
        FROM tele WHERE is_reject GROUP BY head_id, status_code""",
)
_R = """SELECT *, CASE WHEN abs(pearson_r) < 0.3 THEN 'weak' WHEN abs(pearson_r) < 0.7 THEN 'moderate'
      WHEN pearson_r IS NOT NULL THEN 'strong' END AS strength,
    CASE WHEN pearson_r > 0 THEN 'positive' WHEN pearson_r IS NOT NULL THEN 'negative' END AS direction
  FROM (SELECT covar_samp(mean_torque_nm, success_rate_pct)
      / nullif(stddev_samp(mean_torque_nm) * stddev_samp(success_rate_pct), 0) AS pearson_r, count(*) AS n_heads
    FROM compared WHERE mean_torque_nm IS NOT NULL AND success_rate_pct IS NOT NULL) WHERE n_heads >= 3"""
register("torque_success_correlation", on_events(heads.torque_success_correlation), HEADS, _R, "pearson_r")
register("torque_success_correlation_test", on_events(heads.torque_success_correlation_test))
register(
    "head_torque_and_rate",
    on_events(heads.head_torque_and_rate),
    HEADS,
    """SELECT head_id, mean_torque_nm, success_rate_pct FROM compared
       WHERE mean_torque_nm IS NOT NULL AND success_rate_pct IS NOT NULL""",
    "mean_torque_nm success_rate_pct",
)

# --- failures ---------------------------------------------------------------------------

register(
    "failure_distribution",
    on_events(failures.failure_distribution),
    TELE,
    "SELECT status_code, count(*) AS n_failures FROM bad GROUP BY status_code",
)
_DAY_SPIKES = f"""SELECT day, n_failures, failure_rate_pct FROM
      (SELECT *, avg(failure_rate_pct) OVER () AS m, stddev_pop(failure_rate_pct) OVER () AS sd, count(*) OVER () AS n
       FROM (SELECT date_trunc('day', "timestamp")::TIMESTAMP AS day, count(*) FILTER (WHERE is_reject) AS n_failures,
         CAST(count(*) FILTER (WHERE is_reject) AS DOUBLE) / count(*) * 100.0 AS failure_rate_pct FROM real GROUP BY 1))
      WHERE {_SPIKES.format(value='failure_rate_pct')}"""
register("daily_failure_spikes", on_events(failures.daily_failure_spikes), TELE, _DAY_SPIKES, "failure_rate_pct")
register(
    "dominant_failure",
    on_events(failures.dominant_failure),
    TELE,
    f"""SELECT head_id, status_code, count, {label('status_code')} AS status_label FROM
        (SELECT head_id, status_code, count(*) AS count FROM bad GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY head_id ORDER BY count DESC, status_code) = 1""",
)
_BURSTS = """SELECT head_id, min("timestamp") AS start_time, max("timestamp") AS end_time, count(*) AS count,
      array_to_string(list_sort(list(DISTINCT status_code)), ',') AS failure_types
    FROM (SELECT *, sum(CASE WHEN is_reject THEN 0 ELSE 1 END) OVER (PARTITION BY head_id ORDER BY "timestamp", counter) AS run FROM real)
    WHERE is_reject GROUP BY head_id, run HAVING count(*) >= 3"""
register("failure_bursts", on_events(failures.failure_bursts), TELE, _BURSTS)
register(
    "failure_correlation",
    on_events(failures.failure_correlation),
    TELE
    + """, some_heads AS (SELECT DISTINCT head_id FROM real),
hours AS (SELECT DISTINCT date_trunc('hour', "timestamp") AS bucket FROM real),
per_hour AS (SELECT date_trunc('hour', "timestamp") AS bucket, head_id, count(*) FILTER (WHERE is_reject) AS v FROM real GROUP BY 1, 2),
cells AS (SELECT bucket, head_id, coalesce(v, 0) AS v FROM hours CROSS JOIN some_heads LEFT JOIN per_hour USING (bucket, head_id))""",
    _CORRELATE.format(heads="some_heads", cells="cells"),
    "correlation",
)
_BY_HOUR = """SELECT CAST(h AS INTEGER) AS hour, coalesce(n, 0) AS n_events, coalesce(f, 0) AS n_failures,
      f * 100.0 / nullif(n, 0) AS failure_rate_pct
    FROM range(24) t(h) LEFT JOIN (SELECT hour("timestamp") AS hr, count(*) AS n, count(*) FILTER (WHERE is_reject) AS f
      FROM real GROUP BY 1) ON hr = h"""
register("failure_by_hour_of_day", on_events(failures.failure_by_hour_of_day), TELE, _BY_HOUR, "failure_rate_pct")
register(
    "hour_of_day_chi2",
    on_events(failures.hour_of_day_chi2),
    TELE + f", by_hour AS ({_BY_HOUR})",
    """SELECT sum(pow(n_failures - n_events * fa / na, 2) / (n_events * fa / na)
           + pow(n_events - n_failures - n_events * (na - fa) / na, 2) / (n_events * (na - fa) / na)) AS chi2, count(*) AS n_hours,
         first(hour ORDER BY failure_rate_pct DESC, hour) AS peak_hour, max(failure_rate_pct) AS peak_failure_rate_pct,
         first(hour ORDER BY failure_rate_pct, hour) AS lowest_hour, min(failure_rate_pct) AS lowest_failure_rate_pct
       FROM (SELECT *, CAST(sum(n_events) OVER () AS DOUBLE) AS na, CAST(sum(n_failures) OVER () AS DOUBLE) AS fa
         FROM by_hour WHERE n_events > 0)""",
    "chi2 peak_failure_rate_pct lowest_failure_rate_pct",
)
register("hour_of_day_test", on_events(failures.hour_of_day_test))
register(
    "failure_summary",
    on_events(failures.failure_summary),
    TELE,
    "SELECT count(*) AS n_failures, count(DISTINCT head_id) AS n_heads FROM bad",
)

# --- production ---------------------------------------------------------------------------

register(
    "drop_events_in_idle",
    lambda s, d: production.drop_events_in_idle(
        production.production(events(s, d)).drop("crosses_idle"), idle(s, d)
    ),
    PRODUCED,
    f"SELECT {EVENT} FROM produced",
    EVENT_DOUBLES,
)
register(
    "drop_idle_crossing_samples",
    lambda s, d: production.drop_idle_crossing_samples(
        production.production(events(s, d)).drop("crosses_idle"), idle(s, d)
    ),
    PRODUCED,
    f"SELECT {EVENT} FROM tagged WHERE NOT crosses_idle",
    EVENT_DOUBLES,
)
register(
    "excluded_speed_samples",
    on_production(production.excluded_speed_samples),
    PRODUCED,
    "SELECT count(*) FILTER (WHERE crosses_idle) AS excluded FROM produced",
)
register(
    "machine_timeline",
    on_production(production.machine_timeline),
    PRODUCED,
    "SELECT hour::TIMESTAMP AS hour, pieces_per_hour, gap_affected FROM hourly WHERE pieces_per_hour > 0",
    "pieces_per_hour",
)
register(
    "machine_throughput",
    on_production(production.machine_throughput),
    PRODUCED,
    """SELECT avg(pieces_per_hour) AS mean, min(pieces_per_hour) AS min, max(pieces_per_hour) AS max,
       stddev_samp(pieces_per_hour) AS std, count(*) AS hours_with_production FROM hourly WHERE pieces_per_hour > 0""",
    "mean min max std",
)
register(
    "machine_throughput_with_idle",
    lambda s, d: production.machine_throughput(
        production.production(events(s, d), idle(s, d), time_range=WEEK, exclude_idle=False)
    ),
    TELE,
    f"""SELECT avg(p) AS mean, min(p) AS min, max(p) AS max, stddev_samp(p) AS std, count(*) AS hours_with_production
        FROM (SELECT CAST(sum(inferred_closure_count) AS DOUBLE) AS p FROM real
          WHERE capping_speed_pph IS NOT NULL AND {WEEK_SQL} GROUP BY date_trunc('hour', "timestamp")) WHERE p > 0""",
    "mean min max std",
)
register(
    "gap_affected_hours",
    on_production(production.gap_affected_hours),
    PRODUCED,
    "SELECT hour::TIMESTAMP AS hour, pieces_per_hour, backlogged_closures FROM hourly WHERE gap_affected",
    "pieces_per_hour",
)
register(
    "throughput_anomalies",
    on_production(production.throughput_anomalies),
    PRODUCED,
    """SELECT hour::TIMESTAMP AS hour, pieces_per_hour, CASE WHEN pieces_per_hour < m THEN 'slowdown' ELSE 'speedup' END AS type
       FROM (SELECT *, avg(pieces_per_hour) OVER () AS m, stddev_pop(pieces_per_hour) OVER () AS sd, count(*) OVER () AS n
         FROM hourly WHERE pieces_per_hour > 0) WHERE n >= 2 AND sd > 0 AND abs(pieces_per_hour - m) > 2 * sd""",
    "pieces_per_hour",
)
_SPEED = "avg(capping_speed_pph) AS mean, {extra} stddev_samp(capping_speed_pph) AS std"
register(
    "head_speed",
    on_production(production.head_speed),
    PRODUCED,
    "SELECT " + _SPEED.format(extra="min(capping_speed_pph) AS min, max(capping_speed_pph) AS max,") + " FROM samples",
    "mean min max std",
)
register(
    "head_speed_timeline",
    on_production(production.head_speed_timeline),
    PRODUCED,
    """SELECT date_trunc('hour', "timestamp")::TIMESTAMP AS hour, avg(capping_speed_pph) AS mean_speed_pph FROM samples GROUP BY 1""",
    "mean_speed_pph",
)
register(
    "head_speed_variability",
    on_production(production.head_speed_variability),
    PRODUCED,
    "SELECT *, std / nullif(mean, 0) AS cv FROM (SELECT head_id, " + _SPEED.format(extra="") + " FROM samples GROUP BY head_id)",
    "mean std cv",
)

# --- idle ------------------------------------------------------------------------------------

_RANGE_SQL = ("TIMESTAMP '2024-01-08 00:00:00'", "TIMESTAMP '2024-01-14 23:59:59'")
_CLIPPED = """(SELECT *, (epoch_us(end_time) - epoch_us(start_time)) / 1e6 AS duration_seconds FROM
    (SELECT greatest(start_time, {0}) AS start_time, least(end_time, {1}) AS end_time FROM idle
     WHERE start_time < {1} AND end_time > {0}))""".format(*_RANGE_SQL)
register("clip_idle", on_idle(production.clip_idle, WEEK), IDLE, f"SELECT * FROM {_CLIPPED}", "duration_seconds")


def _utilization_sql(source: str, window: str) -> str:
    return f"""SELECT count, coalesce(mean_s, 0.0) AS mean_duration_s, coalesce(median_s, 0.0) AS median_duration_s,
        coalesce(max_s, 0.0) AS max_duration_s, coalesce(total, 0.0) AS total_idle_seconds,
        productive / nullif(w, 0) AS utilization_rate, w / 3600.0 AS observation_window_hours, productive / 3600.0 AS productive_hours
      FROM (SELECT *, greatest(w - coalesce(total, 0.0), 0.0) AS productive FROM
        (SELECT count(*) AS count, avg(duration_seconds) AS mean_s, quantile_cont(duration_seconds, 0.5) AS median_s,
          max(duration_seconds) AS max_s, sum(duration_seconds) AS total, {window} AS w FROM {source}))"""


_UTILIZATION_DOUBLES = (
    "mean_duration_s median_duration_s max_duration_s total_idle_seconds utilization_rate"
    " observation_window_hours productive_hours"
)
_SPAN = "(epoch_us(max(end_time)) - epoch_us(min(start_time))) / 1e6"
register("utilization", on_idle(production.utilization), IDLE, _utilization_sql("idle", _SPAN), _UTILIZATION_DOUBLES)
register(
    "utilization_in_range",
    on_idle(production.utilization, WEEK),
    IDLE,
    _utilization_sql(_CLIPPED, f"(epoch_us({_RANGE_SQL[1]}) - epoch_us({_RANGE_SQL[0]})) / 1e6"),
    _UTILIZATION_DOUBLES,
)
register(
    "idle_by_hour_of_day",
    on_idle(production.idle_by_hour_of_day),
    IDLE
    + """, pieces AS (SELECT start_time, end_time, unnest(generate_series(date_trunc('hour', start_time)::TIMESTAMP, end_time, INTERVAL 1 HOUR)) AS h FROM idle)""",
    """SELECT CAST(r.h AS INTEGER) AS hour, coalesce(s, 0.0) AS idle_seconds FROM range(24) r(h) LEFT JOIN
       (SELECT hour(h) AS hr, sum((epoch_us(least(end_time, h + INTERVAL 1 HOUR)) - epoch_us(greatest(start_time, h))) / 1e6) AS s
        FROM pieces GROUP BY 1) ON hr = r.h""",
    "idle_seconds",
)
register(
    "longest_idle",
    on_idle(production.longest_idle),
    IDLE,
    "SELECT * FROM idle ORDER BY duration_seconds DESC, start_time LIMIT 10",
    "duration_seconds",
)
register(
    "idle_summary",
    on_idle(quality.idle_summary),
    IDLE,
    """SELECT count(*) AS idle_periods, sum(duration_seconds) / 3600.0 AS total_idle_hours,
         max(duration_seconds) / 3600.0 AS longest_hours,
         first(start_time ORDER BY duration_seconds DESC, start_time) AS longest_start,
         first(end_time ORDER BY duration_seconds DESC, start_time) AS longest_end FROM idle""",
    "total_idle_hours longest_hours",
)

# --- listings --------------------------------------------------------------------------------

_LISTED = '"timestamp", head_id, status_code, status_label, torque_nm'
for outcome, condition in {"all": "true", "successful": "status_code = 0", "failed": "is_reject"}.items():
    register(
        f"list_events_{outcome}",
        on_events(listing.list_events, outcome, None, None, 5.0, 120.0),
        TELE,
        f"""SELECT {_LISTED} FROM real WHERE {condition} AND torque_nm >= 5.0 AND torque_nm <= 120.0
            ORDER BY "timestamp" DESC, head_id, counter LIMIT 200""",
        "torque_nm",
    )
    register(
        f"list_events_total_{outcome}",
        on_events(listing.list_events_total, outcome, None, None, 5.0, 120.0),
        TELE,
        f"""SELECT count(*) AS total_matching, count(*) > 200 AS truncated FROM real
            WHERE {condition} AND torque_nm >= 5.0 AND torque_nm <= 120.0""",
    )

# --- chart series ------------------------------------------------------------------------------

register(
    "series_torque_over_time",
    on_events(series.series_torque_over_time),
    TELE,
    """SELECT 'overall' AS head_id, date_trunc('day', "timestamp")::TIMESTAMP AS day, avg(torque_nm) AS mean_torque_nm FROM good GROUP BY 2""",
    "mean_torque_nm",
)
register(
    "series_torque_over_time_heads",
    on_events(series.series_torque_over_time, TRIO),
    TELE,
    """SELECT head_id, date_trunc('day', "timestamp")::TIMESTAMP AS day, avg(torque_nm) AS mean_torque_nm FROM good
       WHERE head_id IN ('H03', 'H07', 'H12') GROUP BY 1, 2""",
    "mean_torque_nm",
)
_HISTOGRAM = """SELECT CAST(b AS INTEGER) AS bin, lo + b * (hi - lo) / 40 AS bin_start, lo + (b + 1) * (hi - lo) / 40 AS bin_end,
      coalesce(n, 0) AS count FROM range(40) t(b) CROSS JOIN band LEFT JOIN
    (SELECT least(floor((torque_nm - lo) / (hi - lo) * 40), 39) AS k, count(*) AS n FROM good CROSS JOIN band
     WHERE torque_nm BETWEEN lo AND hi GROUP BY 1) ON k = b"""
_BAND = TELE + ", band AS (SELECT quantile_cont(torque_nm, 0.005) AS lo, quantile_cont(torque_nm, 0.995) AS hi FROM good)"
register("series_torque_histogram", on_events(series.series_torque_histogram), _BAND, _HISTOGRAM, "bin_start bin_end")
register(
    "series_success_per_head",
    on_events(series.series_success_per_head),
    TELE,
    f"""SELECT "group" AS head_id, success_rate_pct, success_rate_pct - avg_group_rate_pct AS deviation_from_avg_pct,
          rank_worst_to_best, flagged FROM ({_rate_sql('head_id', rank=True)})""",
    "success_rate_pct deviation_from_avg_pct",
)
register(
    "series_failures_per_day",
    on_events(series.series_failures_per_day),
    TELE,
    """SELECT day, failures, count(*) OVER () >= 2 AND stddev_pop(failures) OVER () > 0
         AND failures > avg(failures) OVER () + 2 * stddev_pop(failures) OVER () AS elevated
       FROM (SELECT date_trunc('day', "timestamp")::TIMESTAMP AS day, count(*) FILTER (WHERE is_reject) AS failures FROM real GROUP BY 1)""",
)
_PER_DAY = """SELECT date_trunc('day', "timestamp")::TIMESTAMP AS day, CAST(sum(inferred_closure_count) AS BIGINT) AS closures
       FROM real WHERE capping_speed_pph IS NOT NULL GROUP BY 1 HAVING sum(inferred_closure_count) > 0"""
register("series_production_per_day", on_events(series.series_production_per_day), TELE, _PER_DAY)
register(
    "series_utilization",
    on_idle(series.series_utilization),
    IDLE,
    f"""SELECT utilization_rate * 100.0 AS utilization_pct, (1.0 - utilization_rate) * 100.0 AS idle_pct
        FROM ({_utilization_sql('idle', _SPAN)}) WHERE utilization_rate IS NOT NULL""",
    "utilization_pct idle_pct",
)
register(
    "series_kpi_dashboard",
    on_both(series.series_kpi_dashboard),
    _BAND + "," + IDLE,
    f"""SELECT 'success_rate_per_head' AS series, "group" AS point, success_rate_pct AS value FROM ({_rate_sql('head_id')})
        UNION ALL SELECT 'torque_histogram', CAST(bin AS VARCHAR), count FROM ({_HISTOGRAM})
        UNION ALL SELECT 'production_over_time', strftime(day, '%Y-%m-%d %H:%M:%S'), closures FROM ({_PER_DAY})
        UNION ALL SELECT 'utilization', 'productive', utilization_rate * 100.0 FROM ({_utilization_sql('idle', _SPAN)})""",
    "value",
)

# --- dashboard and reports ------------------------------------------------------------------------

_KPI_VIEWS = (
    PRODUCED
    + ","
    + HEADS[len(TELE) + 1 :]
    + f""", odd AS (SELECT r.* FROM real r JOIN ({_BOUNDS['zscore']}) b USING (head_id) WHERE torque_nm < lower OR torque_nm > upper),
span AS (SELECT min("timestamp") AS a, max("timestamp") AS z FROM tele),
clipped AS (SELECT epoch_us(least(end_time, z)) / 1e6 - epoch_us(greatest(start_time, a)) / 1e6 AS s FROM idle CROSS JOIN span
  WHERE start_time < z AND end_time > a),
observed AS (SELECT (epoch_us(z) - epoch_us(a)) / 1e6 AS w, (SELECT coalesce(sum(s), 0) FROM clipped) AS idle_s FROM span)"""
)
register(
    "kpi_dashboard",
    on_both(dashboard.kpi_dashboard),
    _KPI_VIEWS,
    """SELECT (SELECT count(*) FROM good) * 100.0 / ((SELECT count(*) FROM good) + (SELECT count(*) FROM bad)) AS overall_success_rate_pct,
      (SELECT count(*) FROM good) AS successful_status_observations, (SELECT count(*) FROM bad) AS failed_status_observations,
      (SELECT avg(torque_nm) FROM good) AS mean_torque_nm,
      (SELECT stddev_pop(mean_torque_nm) FROM heads) AS torque_stability_std_across_heads,
      (SELECT avg(pieces_per_hour) FROM hourly WHERE pieces_per_hour > 0) AS machine_wide_throughput_pph,
      (SELECT count(*) FROM hourly WHERE pieces_per_hour > 0) AS production_hours_with_closures,
      (SELECT avg(capping_speed_pph) FROM samples) AS per_head_average_speed_pph,
      greatest(w - idle_s, 0) / w * 100.0 AS utilization_rate_pct,
      (SELECT head_id FROM compared WHERE successful IS NOT NULL ORDER BY success_rate_pct NULLS FIRST, head_id LIMIT 1) AS worst_head,
      (SELECT success_rate_pct FROM compared WHERE successful IS NOT NULL ORDER BY success_rate_pct NULLS FIRST, head_id LIMIT 1) AS worst_head_rate_pct,
      (SELECT head_id FROM compared WHERE successful IS NOT NULL ORDER BY success_rate_pct DESC NULLS LAST, head_id DESC LIMIT 1) AS best_head,
      (SELECT success_rate_pct FROM compared WHERE successful IS NOT NULL ORDER BY success_rate_pct DESC NULLS LAST, head_id DESC LIMIT 1) AS best_head_rate_pct,
      (SELECT count(*) FROM odd) AS n_anomalies, idle_s / 3600.0 AS total_idle_hours, w / 3600.0 AS observation_window_hours
    FROM observed""",
    "overall_success_rate_pct mean_torque_nm torque_stability_std_across_heads machine_wide_throughput_pph"
    " per_head_average_speed_pph utilization_rate_pct worst_head_rate_pct best_head_rate_pct total_idle_hours"
    " observation_window_hours",
)
register(
    "report_ranking",
    on_events(dashboard.report_ranking),
    HEADS,
    "SELECT *, CAST(row_number() OVER (ORDER BY rank_success_rate NULLS LAST, head_id) AS INTEGER) AS position FROM ranked",
    _HEAD_DOUBLES,
)
register(
    "report_kpi_findings",
    on_both(dashboard.report_kpi_findings),
    _KPI_VIEWS + ", gaps AS (SELECT * FROM hourly WHERE gap_affected)",
    f"""SELECT (SELECT count(*) FROM tele) AS total_events, (SELECT count(DISTINCT head_id) FROM tele) AS n_heads,
      a AS start_time, z AS end_time, (SELECT count(*) FROM gaps) AS gap_hours, (SELECT min(hour)::TIMESTAMP FROM gaps) AS first_gap_hour,
      (SELECT pieces_per_hour FROM gaps ORDER BY hour LIMIT 1) AS first_gap_pieces,
      (SELECT backlogged_closures FROM gaps ORDER BY hour LIMIT 1) AS first_gap_backlog,
      (SELECT min(mean_torque_nm) FROM heads) AS least_mean_torque, (SELECT max(mean_torque_nm) FROM heads) AS most_mean_torque,
      b.*, (SELECT count(*) FROM flagged) AS n_flags, (SELECT count(*) FROM idle) AS n_idle_periods
    FROM span CROSS JOIN ({_BUSIEST}) b""",
    "first_gap_pieces least_mean_torque most_mean_torque",
)
register(
    "report_anomaly_heads",
    on_events(dashboard.report_anomaly_heads),
    _odd_views("zscore"),
    "SELECT head_id, count(*) AS n_anomalies FROM odd GROUP BY head_id ORDER BY 2 DESC, 1 LIMIT 10",
)
register(
    "report_failure_codes",
    on_events(dashboard.report_failure_codes),
    TELE,
    f"SELECT status_code, count(*) AS n_failures, {label('status_code')} AS status_label FROM bad GROUP BY status_code",
)
register(
    "report_variability",
    on_events(dashboard.report_variability),
    HEADS,
    """SELECT side, position, head_id, std_torque_nm, mean_torque_nm, std_torque_nm / nullif(mean_torque_nm, 0) AS coefficient_of_variation FROM
       (SELECT 'highest' AS side, CAST(row_number() OVER (ORDER BY std_torque_nm DESC, head_id) AS INTEGER) AS position, * FROM compared WHERE std_torque_nm IS NOT NULL
        UNION ALL SELECT 'lowest', CAST(row_number() OVER (ORDER BY std_torque_nm, head_id DESC) AS INTEGER), * FROM compared WHERE std_torque_nm IS NOT NULL)
       WHERE position <= 5""",
    "std_torque_nm mean_torque_nm coefficient_of_variation",
)
register(
    "report_head_spread",
    on_events(dashboard.report_head_spread),
    HEADS,
    """SELECT min(mean_torque_nm) AS least_mean, max(mean_torque_nm) AS most_mean,
         (max(mean_torque_nm) - min(mean_torque_nm)) / nullif(min(mean_torque_nm), 0) * 100.0 AS mean_spread_pct,
         min(std_torque_nm) AS least_std, max(std_torque_nm) AS most_std, max(total_closures) - min(total_closures) AS volume_spread,
         (max(total_closures) - min(total_closures)) / nullif(CAST(min(total_closures) AS DOUBLE), 0) * 100.0 AS volume_spread_pct FROM heads""",
    "least_mean most_mean mean_spread_pct least_std most_std volume_spread_pct",
)


def _long(tables):
    """How many rows each table of a report has."""
    rows = [t.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows")) for name, t in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


register("report_anomaly", lambda s, d: _long(dashboard.report_anomaly(events(s, d))))
register("report_head_comparison", lambda s, d: _long(dashboard.report_head_comparison(events(s, d))))
register("report_kpi", lambda s, d: _long(dashboard.report_kpi(events(s, d), idle(s, d))))
register("analytics_suite", lambda s, d: _long(dashboard.analytics_suite(events(s, d), idle(s, d))))


# --- hourly cells ---------------------------------------------------------------------------------


def cells(spark, folder):
    """Cells stored beside the events, as an ingest leaves them."""
    return stored(spark, folder, "hourly_cells", lambda: rollup.hourly_cells(events(spark, folder), idle(spark, folder)))


register(
    "hourly_cells",
    lambda s, d: cells(s, d).groupBy("hour", "head_id", "status_code", "in_idle", "crosses_idle").agg(
        F.sum("n").alias("n"), F.sum("closures").alias("closures"), F.sum("torque_n").alias("torque_n"),
        F.min("torque_min").alias("torque_min"), F.max("speed_max").alias("speed_max"),
    ),
    PRODUCED
    + """, every AS (SELECT t.*, coalesce(t."timestamp" <= i.end_time, false) AS in_idle,
    coalesce(epoch_us(t."timestamp") - CAST(round(t.time_since_last_closure * 1e6) AS BIGINT) <= epoch_us(e.end_time)
      AND t."timestamp" > e.end_time, false) AS crosses_idle
  FROM tele t ASOF LEFT JOIN idle i ON t."timestamp" >= i.start_time
    ASOF LEFT JOIN idle_ends e ON t."timestamp" >= e.end_time)""",
    """SELECT date_trunc('hour', "timestamp") AS hour, head_id, status_code, in_idle, crosses_idle, count(*) AS n,
         CAST(sum(inferred_closure_count) AS BIGINT) AS closures, count(torque_nm) AS torque_n, min(torque_nm) AS torque_min,
         max(capping_speed_pph) AS speed_max FROM every GROUP BY ALL""",
    "torque_min speed_max",
)
for _group in rollup.GROUPINGS:
    _same = {"overall": "success_rate_overall", "per_head": "success_rate_per_head", "daily": "success_rate_daily", "hourly": "success_rate_hourly"}[_group]
    if _same in ORACLE:
        QUERIES[f"rollup_{_same}"] = lambda s, d, g=_group: rounded(rollup.success_rate(cells(s, d), g))
        ORACLE[f"rollup_{_same}"] = ORACLE[_same]
for _name, _operator in {
    "dataset_summary": rollup.dataset_summary,
    "head_comparison": rollup.head_comparison,
    "machine_throughput": rollup.machine_throughput,
    "gap_affected_hours": rollup.gap_affected_hours,
    "head_speed": rollup.head_speed,
    "head_speed_variability": rollup.head_speed_variability,
    "failure_distribution": rollup.failure_distribution,
    "dominant_failure": rollup.dominant_failure,
    "daily_failure_spikes": rollup.daily_failure_spikes,
    "hourly_failure_spikes": rollup.hourly_failure_spikes,
    "failure_by_hour_of_day": rollup.failure_by_hour_of_day,
    "failure_correlation": rollup.failure_correlation,
}.items():
    if _name in ORACLE:  # the same SQL over events must agree with cells
        QUERIES[f"rollup_{_name}"] = lambda s, d, f=_operator: rounded(f(cells(s, d)))
        ORACLE[f"rollup_{_name}"] = ORACLE[_name]
QUERIES["rollup_kpi_dashboard"] = lambda s, d: rounded(dashboard.kpi_dashboard(events(s, d), idle(s, d), cells=cells(s, d)))
ORACLE["rollup_kpi_dashboard"] = ORACLE["kpi_dashboard"]

# --- samples --------------------------------------------------------------------------------------

_DRAWN = """, drawn AS (SELECT *, row_number() OVER (PARTITION BY head_id
    ORDER BY md5('42:' || head_id || ':' || epoch_us("timestamp") || ':' || counter)) AS place FROM good WHERE torque_nm IS NOT NULL)"""
register(
    "sample_per_head",
    lambda s, d: heads.sample_per_head(events(s, d), 20).select("head_id", "timestamp", "counter", "torque_nm"),
    TELE + _DRAWN,
    'SELECT head_id, "timestamp", counter, torque_nm FROM drawn WHERE place <= 20',
    "torque_nm",
)
register(
    "kruskal_wallis_sampled",
    on_events(heads.kruskal_wallis, None, None, 20),
    TELE + _DRAWN + """, sampled AS (SELECT head_id, torque_nm FROM drawn WHERE place <= 20),
ranks AS (SELECT head_id, rank() OVER (ORDER BY torque_nm) + (count(*) OVER (PARTITION BY torque_nm) - 1) / 2.0 AS r FROM sampled),
per_head AS (SELECT count(*)::DOUBLE AS n, sum(r) AS s FROM ranks GROUP BY head_id),
whole AS (SELECT count(*)::DOUBLE AS n FROM sampled),
ties AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM sampled GROUP BY torque_nm))""",
    """SELECT (SELECT sum(p.n * power(p.s / p.n - (w.n + 1) / 2, 2)) FROM per_head p) * 12 / (w.n * (w.n + 1))
         / (1 - (SELECT t FROM ties) / (power(w.n, 3) - w.n)) AS h_statistic,
         (SELECT count(*) FROM per_head) AS n_groups, CAST(w.n AS BIGINT) AS n_observations FROM whole w""",
    "h_statistic",
)

# --- approximate quantiles ------------------------------------------------------------------------


def torque_sketches(spark, folder):
    return stored(spark, folder, "torque_sketches", lambda: sketches.daily_sketches(events(spark, folder)))


register(
    "torque_sketches",
    lambda s, d: torque_sketches(s, d).select(F.col("day").cast("string").alias("day"), "head_id", "n_observations"),
    TELE,
    'SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, head_id, count(*) AS n_observations FROM good WHERE torque_nm IS NOT NULL GROUP BY ALL',
)


def approximate_quartiles(spark, folder):
    """Quartiles of the heads from their sketches, and whether their exact ranks
    over the events keep the stated bound."""
    errors = sketches.rank_errors(events(spark, folder), sketches.approximate_quantiles(torque_sketches(spark, folder)))
    return errors.select("head_id", "n_observations", (F.col("largest_error") <= sketches.RANK_ERROR).alias("within_bound"))


register(
    "torque_quantiles_approximate",
    approximate_quartiles,
    TELE,
    "SELECT head_id, count(*) AS n_observations, true AS within_bound FROM good WHERE torque_nm IS NOT NULL GROUP BY head_id",
)
