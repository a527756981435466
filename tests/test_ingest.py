import pytest
from machine import account, at, one_head, random_archive, raw_500, split, write
from pyspark.sql import functions as F

from spindle.operators import counters, idle, quality, readings
from spindle.operators.ingest import base_name, repair
from spindle.sources.raw_csv import read_wide_csv


@pytest.fixture
def small_blocks(spark):
    """Make scans split files into blocks of a few rows."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def staged(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def repaired(spark, files, folder):
    wide = staged(spark, readings.with_steps(read_wide_csv(spark, write(files, folder)).wide), folder / "_wide")
    done = staged(spark, repair(readings.count_changes(wide)), folder / "_repaired")
    named = lambda df: df.withColumn("source_file", base_name())
    return named(wide), named(done)


def events_of(done):
    rows = counters.detect_closures(counters.reset_segments(done)).collect()
    return [(r.timestamp, r.head_id, r.segment_id, r.counter, r.counter_delta, r.data_quality, r.source_file) for r in rows]


def found(spark, files, folder):
    wide, done = repaired(spark, files, folder)
    return {
        "events": sorted(events_of(done)),
        "resets": sorted(tuple(r) for r in counters.counter_resets(counters.reset_segments(done)).collect()),
        "masked": quality.masked_rows(done).agg(F.coalesce(F.sum("masked_counts"), F.lit(0))).first()[0],
        "idle": sorted(tuple(r) for r in idle.idle_periods(wide).collect()),
    }


def as_lists(result):
    return {k: sorted(v) if isinstance(v, list) else v for k, v in result.items()}


def deltas(result):
    return [(e[3], e[4], e[5]) for e in result["events"]]


def test_jump_is_one_aggregated_event(spark, tmp_path):
    assert deltas(found(spark, one_head([10, 11, 14]), tmp_path / "a")) == [(11, 1, "single"), (14, 3, "aggregated")]


def test_increment_over_a_pause_is_a_gap(spark, tmp_path):
    files = one_head([10, 10, 10, 10, (10, 13)])
    assert deltas(found(spark, files, tmp_path / "a")) == [(13, 3, "gap")]


def test_reset_is_logged_and_is_no_event(spark, tmp_path):
    got = found(spark, one_head([10, 11, 5]), tmp_path / "a")
    assert deltas(got) == [(11, 1, "single")]
    assert got["resets"] == [(at(2), "H01", 11.0, 5.0, 0, 1, "day01.csv")]


def test_segments_start_anew_after_a_reset(spark, tmp_path):
    got = found(spark, one_head([10, 11, 0, 0, 1]), tmp_path / "a")
    assert [(e[2], e[3]) for e in got["events"]] == [(0, 11), (1, 1)]


@pytest.mark.parametrize(
    "days, masked, events, resets",
    [
        ([[100, 0, 0, 103]], 2, [(103, 3, "aggregated")], 0),
        ([[1000, 0, 0, 5]], 0, [(5, 5, "aggregated")], 1),
        ([[100, 0, 0]], 0, [], 1),
        ([[99, 100], [0, 1]], 0, [(100, 1, "single"), (1, 1, "single")], 1),
        ([[100, 0, 0], [0, 103]], 3, [(103, 3, "aggregated")], 0),
        ([[1000, 0, 0], [0, 5]], 0, [(5, 5, "aggregated")], 1),
        ([[100, 0, None, 103]], 0, [(103, 103, "aggregated")], 1),
        ([[100, 0], [0, 0, 0], [None], [0, 101]], 5, [(101, 1, "single")], 0),
        ([[100, 0], [0, 0, 0], [0, None, 101]], 4, [(101, 101, "aggregated")], 1),
    ],
)
def test_zero_runs(spark, tmp_path, small_blocks, days, masked, events, resets):
    files = one_head(*days)
    got = found(spark, files, tmp_path / "a")
    assert got == as_lists(account(files))
    assert (got["masked"], sorted(deltas(got)), len(got["resets"])) == (masked, sorted(events), resets)


def test_single_row_has_no_event(spark, tmp_path):
    assert found(spark, one_head([42]), tmp_path / "a")["events"] == []


def test_archive_of_500_rows(spark, tmp_path):
    got = found(spark, [raw_500()], tmp_path / "a")
    per_head = {h: sum(e[1] == h for e in got["events"]) for h in ("H01", "H02", "H03")}
    assert per_head == {"H01": 439, "H02": 220, "H03": 390}
    assert {e[5] for e in got["events"]} == {"single"}
    assert got["idle"] == [(at(300), at(359), 59.0)]
    assert got == as_lists(account([raw_500()]))


def test_split_archive_equals_whole(spark, tmp_path):
    whole = found(spark, [raw_500()], tmp_path / "a")
    halves = found(spark, split(raw_500(), 250), tmp_path / "b")
    assert [e[:6] for e in whole["events"]] == [e[:6] for e in halves["events"]]
    assert whole["idle"] == halves["idle"]


def test_idle_run_split_over_three_files(spark, tmp_path):
    got = found(spark, split(raw_500(), 310, 340), tmp_path / "a")
    assert got["idle"] == [(at(300), at(359), 59.0)]


@pytest.mark.parametrize("seed", range(8))
def test_random_archives(spark, tmp_path, small_blocks, seed):
    files = random_archive(seed)
    assert found(spark, files, tmp_path / "a") == as_lists(account(files))


def test_short_idle_is_dropped(spark, tmp_path):
    files = one_head([1] * 5, status=2)
    assert found(spark, files, tmp_path / "a")["idle"] == []


def test_idle_is_cut_where_sampling_pauses(spark, tmp_path):
    files = one_head([1] * 40 + [(3600, 1)] + [1] * 39, status=2)
    got = found(spark, files, tmp_path / "a")["idle"]
    assert [d for *_, d in got] == [39.0, 39.0]


def test_trailing_zero_rows_are_counted(spark, tmp_path, small_blocks):
    files = one_head([100] + [0] * 30, torque=0.0)
    wide, done = repaired(spark, files, tmp_path / "a")
    assert [r.trailing_zero_rows for r in quality.trailing_zero_rows(wide).collect()] == [30]
    assert done.where("masked").count() == 0


def test_quality_by_hand(spark, tmp_path, small_blocks):
    for seed in (3, 4):
        files = random_archive(seed, n_files=3)
        wide, done = repaired(spark, files, tmp_path / f"q{seed}")
        rows = sum(len(f.rows) for f in files)
        total = quality.quality_totals(wide, done).first()
        assert total.total_rows == rows and total.files_processed == 3
        got = account(files)
        assert total.corrupted_rows_masked_total == got["masked"]
        assert total.counter_resets_total == len(got["resets"])
        negative = sum((v[h][1] or 0) < 0 for f in files for _, v in f.rows for h in v)
        assert total.negative_torque_total == negative
        empty = sum(c is None for f in files for _, v in f.rows for h in v for c in v[h])
        assert total.missing_cells_total == empty + got["masked"]


def test_ingest_of_an_archive_without_events(spark, tmp_path):
    from spindle.operators.ingest import ingest
    from spindle.sources.tables import load_closure_events

    flat = ingest(spark, write(one_head([5] * 20, [5] * 20), tmp_path / "flat"), str(tmp_path / "flat_out"))
    assert flat.closure_events.count() == 0 and load_closure_events(spark, str(tmp_path / "flat_out")).count() == 0
    assert flat.quality["quality_totals"].count() == 1


def test_ingest_of_rejected_files_only(spark, tmp_path):
    from spindle.operators.ingest import ingest

    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.csv").write_text("time,x\n1,2\n")
    result = ingest(spark, str(tmp_path / "bad"), str(tmp_path / "bad_out"))
    assert result.closure_events.count() == 0 and result.idle_periods.count() == 0
    assert result.quality["schema_errors"].count() > 0


def test_speed_of_events_at_one_time_does_not_depend_on_their_order(spark):
    from spindle.operators.events import derive_speed

    rows = [(at(s), "H01", 1, "a.csv", c) for s, c in [(0, 1), (10, 2), (10, 3), (25, 4)]]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "timestamp timestamp_ntz, head_id string, inferred_closure_count long, source_file string, counter long")
        assert [r.time_since_last_closure for r in derive_speed(df).orderBy("counter").collect()] == [None, 10.0, 0.0, 15.0]
