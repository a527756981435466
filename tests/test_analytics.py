"""Known figures on small event tables."""

from datetime import datetime, timedelta

import pytest

from spindle.functions.columns import format_percentage
from spindle.operators import anomaly, dashboard, failures, filters, heads, listing, production, series, summary, torque
from spindle.operators.events import dedupe_events, derive_speed, duplicates_removed, enrich_status

BLOCK = (
    "timestamp timestamp_ntz, head_id string, segment_id long, counter long, counter_delta long,"
    " inferred_closure_count long, data_quality string, torque_nm double, status_code int, source_file string"
)
IDLE = "start_time timestamp_ntz, end_time timestamp_ntz, duration_seconds double"


def block(head, start, n, minutes, status, torque_nm, first=1, pieces=1):
    t = datetime.fromisoformat(start)
    codes = status if isinstance(status, list) else [status] * n
    values = torque_nm if isinstance(torque_nm, list) else [torque_nm] * n
    return [
        (t + timedelta(minutes=minutes * i), head, 0, first + i, pieces, pieces, "single", values[i], codes[i], "f.csv")
        for i in range(n)
    ]


def table(spark, *blocks):
    rows = [r for b in blocks for r in b]
    return derive_speed(enrich_status(spark.createDataFrame(rows, BLOCK)))


def idle_table(spark, *hours):
    day = datetime(2026, 1, 1)
    rows = [(day + timedelta(hours=a), day + timedelta(hours=b), (b - a) * 3600.0) for a, b in hours]
    return spark.createDataFrame(rows, IDLE)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    df = table(
        spark,
        block("H01", "2026-01-01T00:00:00", 80, 60, 0, 2.0),
        block("H02", "2026-01-01T00:30:00", 35, 60, 0, 2.2),
        block("H02", "2026-02-01T00:00:00", 35, 60, 65, 0.05, first=36),
        block("H03", "2026-02-01T00:15:00", 50, 60, 65, 1.8),
    )
    path = str(tmp_path_factory.mktemp("events") / "t")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def idle(spark):
    return idle_table(spark, (1, 2), (3, 3.5), (5, 6.5))


def test_rates_and_order(events):
    rows = summary.success_rate(events, "per_head").orderBy("rank_worst_to_best").collect()
    assert [(r.group, r.success_rate_pct) for r in rows] == [("H03", 0.0), ("H02", 50.0), ("H01", 100.0)]


@pytest.mark.parametrize("span, want", [(("2026-02-01", "2026-02-28"), {"H02": 35, "H03": 50}), (("2026-01-01", "2026-01-31"), {"H01": 80, "H02": 35})])
def test_time_range(events, span, want):
    rows = summary.success_rate(events, "per_head", None, span).collect()
    assert {r.group: r.total_closures for r in rows} == want


def test_busiest_failures_and_dominant(events):
    busy = heads.busiest_quietest(heads.head_comparison(events)).first()
    assert (busy.busiest_head, busy.busiest_closures, busy.quietest_head, busy.quietest_closures) == ("H01", 80, "H03", 50)
    assert [tuple(r) for r in failures.failure_distribution(events).collect()] == [(65, 85)]
    assert {r.head_id: r["count"] for r in failures.dominant_failure(events).collect()} == {"H02": 35, "H03": 50}


def test_no_load_and_null_codes_leave_the_rate_alone(spark):
    df = table(spark, block("H01", "2026-01-01", 16, 1, [0] * 10 + [2] * 5 + [None], 2.0))
    row = summary.success_rate(df).first()
    assert (row.total_closures, row.success_rate_pct, row.other_count) == (10, 100.0, 0)
    assert heads.head_comparison(df).first().total_closures == 16


def test_torque_moments_and_constant(spark):
    df = table(spark, block("H01", "2026-01-01", 101, 1, 0, [2.4] * 50 + [2.5] + [2.6] * 50))
    row = torque.torque_statistics(df).first()
    assert row["count"] == 101 and row["mean"] == pytest.approx(2.5) and row["std"] == pytest.approx(0.1)
    flat = table(spark, block("H01", "2026-01-01", 20, 1, 0, 2.0))
    assert torque.torque_statistics(flat).first()["std"] == 0.0
    assert anomaly.anomalies(flat).count() == 0
    assert [r.correlation for r in heads.success_rate_correlation(flat).collect()] == []


def test_threshold_anomalies(spark):
    df = table(spark, block("H01", "2026-01-01", 105, 1, 0, [2.0] * 100 + [10.0, 10.5, 11.0, 0.01, 0.02]))
    flagged = anomaly.anomalies(df, "threshold", (1.5, 2.5))
    assert flagged.count() == 5
    worst = anomaly.top_anomalies(flagged, 2).collect()
    assert [r.torque_nm for r in worst] == [11.0, 10.5]
    assert worst[0].reason == "torque 11.0 Nm above expected upper bound 2.5"


@pytest.mark.parametrize(
    "codes, bursts",
    [
        ([0] * 10 + [65] * 3 + [0] * 10, [(3, "65")]),
        ([0] * 5 + [65] * 2 + [0] * 5, []),
        ([65, 2, 9, 2, 65, 4, 65], [(3, "9,65")]),
        ([9, 9, 4, 9, 9], []),
    ],
)
def test_bursts(spark, codes, bursts):
    df = table(spark, block("H01", "2026-01-01", len(codes), 1, codes, 2.0))
    assert [(r["count"], r.failure_types) for r in failures.failure_bursts(df).collect()] == bursts


def test_hour_effect(spark):
    codes = [65 if i // 60 == 3 else 0 for i in range(1440)]
    df = table(spark, block("H01", "2026-01-01", 1440, 1, codes, 2.0))
    rows = failures.failure_by_hour_of_day(df).collect()
    assert len(rows) == 24 and [(r.n_events, r.n_failures) for r in rows if r.hour == 3] == [(60, 60)]
    test = failures.hour_of_day_test(df).first()
    assert test.significant and test.peak_hour == 3 and test.chi2 == pytest.approx(1440.0)


def test_two_hours_use_yates_and_one_hour_gives_no_test(spark):
    codes = [65] * 8 + [0] * 52 + [65] * 2 + [0] * 58
    df = table(spark, block("H01", "2026-01-01", 120, 1, codes, 2.0))
    a, b, c, d = 8, 52, 2, 58
    yates = 120 * (abs(a * d - b * c) - 60) ** 2 / (60 * 60 * 10 * 110)
    assert failures.hour_of_day_test(df).first().chi2 == pytest.approx(yates)
    one = table(spark, block("H01", "2026-01-01", 50, 1, [65] + [0] * 49, 2.0))
    assert failures.hour_of_day_chi2(one).count() == 0


def at(text):
    return datetime.fromisoformat(f"2026-01-01T{text}")


def test_speed_over_an_idle_period(spark):
    times = ["09:59:56", "09:59:58", "12:00:02", "12:00:04"]
    rows = [(at(t), "H01", 0, i, 1, 1, "single", 2.0, 0, "f.csv") for i, t in enumerate(times)]
    df = derive_speed(enrich_status(spark.createDataFrame(rows, BLOCK)))
    idle = idle_table(spark, (10, 12))
    made = production.production(df, idle)
    assert production.excluded_speed_samples(made).first().excluded == 1
    assert production.head_speed(made).first()["mean"] == 1800.0
    assert {r.hour.hour: r.pieces_per_hour for r in production.machine_timeline(made).collect()} == {9: 1.0, 12: 2.0}
    kept = production.production(df, idle, exclude_idle=False)
    assert production.excluded_speed_samples(kept).first().excluded == 0
    late = production.production(df, idle, time_range=("2026-01-01T12:00:03", "2026-01-01T12:00:05"))
    assert production.excluded_speed_samples(late).first().excluded == 0
    assert production.head_speed(late).first()["mean"] == 1800.0


def hours(a, b):
    return (datetime(2026, 1, 1) + timedelta(hours=a)).isoformat(), (datetime(2026, 1, 1) + timedelta(hours=b)).isoformat()


@pytest.mark.parametrize(
    "periods, window, rate, count, total",
    [
        ([(1, 2), (3, 3.5), (5, 6.5)], hours(0, 10), 0.7, 3, 10800.0),
        ([(0, 2)], hours(1, 3), 0.5, 1, 3600.0),
        ([(0, 4)], hours(1, 3), 0.0, 1, 7200.0),
        ([(0, 1)], hours(2, 4), 1.0, 0, 0.0),
        ([(0, 1)], hours(1, 4), 1.0, 0, 0.0),
        ([], hours(1, 4), 1.0, 0, 0.0),
        ([], None, None, 0, 0.0),
    ],
)
def test_utilization(spark, periods, window, rate, count, total):
    row = production.utilization(idle_table(spark, *periods), window).first()
    assert (row["count"], row.total_idle_seconds) == (count, total)
    assert row.utilization_rate is None if rate is None else row.utilization_rate == pytest.approx(rate)


def test_idle_hours_over_midnight(spark):
    got = {r.hour: r.idle_seconds for r in production.idle_by_hour_of_day(idle_table(spark, (23.5, 25.25))).collect()}
    assert got == {h: {23: 1800.0, 0: 3600.0, 1: 900.0}.get(h, 0.0) for h in range(24)}


def test_dashboard(events, idle):
    row = dashboard.kpi_dashboard(events, idle).first()
    assert (row.worst_head, row.best_head, row.successful_status_observations) == ("H03", "H01", 115)
    assert row.failed_status_observations == 85


def test_empty_tables(spark, events, idle):
    none, no_idle = events.limit(0), idle.limit(0)
    assert summary.dataset_summary(none).first().total_events == 0
    for df in (
        summary.success_rate(none, "per_head"),
        torque.torque_statistics(none),
        torque.torque_changepoints(none),
        anomaly.anomalies(none),
        failures.failure_bursts(none),
        heads.kruskal_wallis_test(none),
        torque.mann_whitney_test(none),
        production.machine_timeline(production.production(none, idle)),
        series.series_torque_histogram(none),
        series.series_utilization(no_idle, hours(0, 1)),
        listing.list_events(none),
    ):
        assert df.count() == 0
    assert dashboard.kpi_dashboard(none, no_idle).first().n_anomalies == 0


def test_dedupe_keeps_the_first(spark):
    rows = [(datetime(2026, 1, 1, 0, 0, i), "H01", 0, c, 1, 1, "single", float(i), 0, "f.csv") for i, c in enumerate((5, 6, 6, 7))]
    df = spark.createDataFrame(rows, BLOCK)
    assert sorted((r.counter, r.torque_nm) for r in dedupe_events(df).collect()) == [(5, 0.0), (6, 1.0), (7, 3.0)]
    assert [tuple(r) for r in duplicates_removed(df).collect()] == [("H01", 1)]


def test_status_map(spark):
    codes = [0, 2, 4, 9, 65, None, 77]
    df = enrich_status(spark.createDataFrame(block("H07", "2026-01-01", 7, 1, codes, 2.0), BLOCK)).orderBy("timestamp")
    rows = df.collect()
    assert [r.classification for r in rows] == ["successful", "no_load", "other", "failed", "failed", "other", "other"]
    assert [r.status_label for r in rows][3:] == ["EarlyRaise", "RotatingAtRaise", "Unknown", "Unknown"]
    assert [r.is_reject for r in rows] == [False, False, False, True, True, False, False]
    assert rows[0].head_number == 7


def test_histogram_includes_its_last_edge(spark):
    df = table(spark, block("H01", "2026-01-01", 5, 1, 0, [1.0, 2.0, 3.0, 4.0, 5.0]))
    rows = series.series_torque_histogram(df).orderBy("bin").collect()
    assert len(rows) == 40 and sum(r["count"] for r in rows) == 3  # 1 and 5 lie outside the band
    flat = series.series_torque_histogram(table(spark, block("H01", "2026-01-01", 5, 1, 0, 2.0))).collect()
    assert sum(r["count"] for r in flat) == 5 and min(r.bin_start for r in flat) == 1.5


def test_listing_is_newest_first_with_inclusive_bounds(events):
    rows = listing.list_events(events, "failed", torque_min=1.8, limit=3).collect()
    assert [r.timestamp for r in rows] == sorted((r.timestamp for r in rows), reverse=True) and rows[0].torque_nm == 1.8
    total = listing.list_events_total(events, "failed", torque_min=1.8, limit=3).first()
    assert (total.total_matching, total.truncated) == (50, True)


def test_percentage_text(spark):
    values = [99.996539, 100.0, 0.0, 0.005, 50.0, None, 99.99]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.t for r in df.select(format_percentage("v").alias("t"), "i").orderBy("i").collect()]
    assert got == ["99.9965%", "100.00%", "0.00%", "0.0050%", "50.00%", "n/a", "99.99%"]


def test_bad_arguments_fail_at_once(events, idle):
    for call in (
        lambda: summary.success_rate(events, "weekly"),
        lambda: torque.torque_statistics(events, "everything"),
        lambda: torque.torque_statistics(events, group_by="hourly"),
        lambda: torque.torque_rolling(events, "7 fortnights"),
        lambda: anomaly.anomalies(events, "guess"),
        lambda: anomaly.anomalies(events, "threshold"),
        lambda: listing.list_events(events, "lost"),
        lambda: series.chart_series(events, idle, "pie"),
        lambda: production.utilization(idle, hours(3, 3)),
        lambda: filters.status_population(events, "none"),
    ):
        with pytest.raises(ValueError):
            call()
