import os

import pytest
from machine import File, account, at, one_head, random_archive, write

from spindle.constants import EVENT_SCHEMA
from spindle.operators import quality, readings
from spindle.operators.ingest import ingest, repair
from spindle.session import cut
from spindle.sources.raw_csv import read_wide_csv
from spindle.streaming import ingest as streaming


def run(spark, folder, out, files_per_batch):
    query = streaming.ingest_stream(spark, folder, out, files_per_batch)
    query.awaitTermination()
    return out


def arrive_in_order(folder, files):
    for i, f in enumerate(files):
        os.utime(folder / f.name, (1_700_000_000 + i, 1_700_000_000 + i))


def streamed(spark, files, folder, files_per_batch=1):
    raw = write(files, folder / "raw")
    arrive_in_order(folder / "raw", files)
    out = run(spark, raw, str(folder / "out"), files_per_batch)
    events = streaming.stream_events(spark, out).collect()
    return {
        "events": sorted((r.timestamp, r.head_id, r.counter, r.counter_delta, r.data_quality, r.source_file) for r in events),
        "resets": sorted(tuple(r) for r in streaming.finish_resets(spark, out).collect()),
        "idle": sorted(tuple(r) for r in streaming.finish_idle(spark, out).collect()),
    }


def expected(files):
    want = account(files)
    return {
        "events": sorted((t, h, c, d, q, f) for t, h, _, c, d, q, f in want["events"]),
        "resets": sorted(want["resets"]),
        "idle": want["idle"],
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_the_account(spark, tmp_path, seed):
    files = random_archive(seed, n_files=4)
    assert streamed(spark, files, tmp_path) == expected(files)


@pytest.mark.parametrize("days", [[[100, 0, 0], [0, 0], [0, 103]], [[1000, 0, 0], [0, 0], [0, 5]]])
def test_zeros_stay_open_over_batches(spark, tmp_path, days):
    files = one_head(*days)
    assert streamed(spark, files, tmp_path) == expected(files)


def test_idle_run_stays_open_over_batches(spark, tmp_path):
    files = one_head([1] * 20, [1] * 20, [1] * 20, status=2)
    assert streamed(spark, files, tmp_path)["idle"] == expected(files)["idle"] != []


@pytest.mark.parametrize("files_per_batch", [1, 2, 4])
def test_modification_times_do_not_matter(spark, tmp_path, files_per_batch):
    files = random_archive(1, n_files=4)
    raw = write(files, tmp_path / "raw")
    arrive_in_order(tmp_path / "raw", files[::-1])
    out = run(spark, raw, str(tmp_path / "out"), files_per_batch)
    want = expected(files)
    assert sorted((r.timestamp, r.head_id, r.counter, r.counter_delta, r.data_quality, r.source_file) for r in streaming.stream_events(spark, out).collect()) == want["events"]
    assert sorted(tuple(r) for r in streaming.finish_resets(spark, out).collect()) == want["resets"]
    assert sorted(tuple(r) for r in streaming.finish_idle(spark, out).collect()) == want["idle"]


def test_a_failed_run_goes_on_with_the_batches_it_began(spark, tmp_path, monkeypatch):
    files = one_head([1, 2, 3], [4, 6], [7])
    raw, out = write(files, tmp_path / "raw"), str(tmp_path / "out")
    whole = streaming.ingest_batch
    monkeypatch.setattr(streaming, "ingest_batch", lambda s, paths, o, n: whole(s, paths, o, n) if n < 2 else 1 / 0)
    with pytest.raises(Exception, match="division"):
        run(spark, raw, out, 1)
    monkeypatch.setattr(streaming, "ingest_batch", whole)
    events = streaming.stream_events(spark, run(spark, raw, out, 3)).collect()
    assert sorted((r.timestamp, r.head_id, r.counter, r.counter_delta, r.data_quality, r.source_file) for r in events) == expected(files)["events"]
    assert streaming.finish_resets(spark, out).count() == 0


def test_a_file_out_of_order_stops_the_stream(spark, tmp_path):
    first, second = one_head([1, 2, 3], [4, 5])
    raw = write([second], tmp_path / "raw")
    run(spark, raw, str(tmp_path / "out"), 1)
    write([first], tmp_path / "raw")
    with pytest.raises(Exception, match="sorts before"):
        run(spark, raw, str(tmp_path / "out"), 1)


def test_batch_ingest_writes_every_table(spark, tmp_path):
    files = random_archive(7, n_files=2)
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "zz_broken.csv").write_text("time,H01 Count\n1,2\n")
    done = ingest(spark, write(files, tmp_path / "raw"), str(tmp_path / "out"))
    want = account(files)
    assert done.closure_events.count() == len(want["events"])
    assert done.quality["schema_errors"].first().file == "zz_broken.csv"
    report = {p.name for p in (tmp_path / "out" / "data_quality").iterdir()}
    assert report == set(done.quality)
    pieces = done.closure_events.groupBy().sum("inferred_closure_count").first()[0]
    assert (pieces or 0) == sum(e[4] for e in want["events"])


def test_statistics_follow_the_events(spark, tmp_path):
    files = one_head([1, 2, 4], [5, 6])
    raw = write(files, tmp_path / "raw")
    arrive_in_order(tmp_path / "raw", files)
    out = run(spark, raw, str(tmp_path / "out"), 1)
    counts = streaming.ingest_statistics(spark, out)
    query = counts.writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = {r.data_quality: (r.events, r.inferred_closures) for r in spark.table("stats").collect()}
    assert rows == {"single": (3, 3), "aggregated": (1, 2)}


QUALITY_KEYS = {"quality_totals", "schema_errors", "schema_warnings", "bad_timestamps", "file_quality", "missing_cells", "trailing_zero_rows", "sampling_gaps", "boundary_gaps", "invalid_torque", "status_distribution", "file_counter_resets", "unexpected_status", "counter_resets", "duplicates_removed", "breakdowns"}


def plain_rows(df):
    names = sorted(df.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return names, sorted((tuple(tidy(r[n]) for n in names) for r in df.collect()), key=repr)


def full_events(df):
    rows = df.select(*[f.name for f in EVENT_SCHEMA]).collect()
    return sorted(map(tuple, rows), key=repr)


def assert_report_equals_batch(spark, files, folder, sizes, broken=()):
    """Returns the tables of the batch ingest, by name, as rows."""
    raw = write(files, folder / "raw")
    for name, text in broken:
        (folder / "raw" / name).write_text(text)
    batch = ingest(spark, raw, str(folder / "batch"))
    want = {name: plain_rows(table) for name, table in batch.quality.items()}
    assert set(want) == QUALITY_KEYS
    for size in sizes:
        out = run(spark, raw, str(folder / f"out{size}"), size)
        got = streaming.finish_quality(spark, out)
        assert {name: plain_rows(table) for name, table in got.items()} == want
        assert full_events(streaming.stream_events(spark, out)) == full_events(batch.closure_events)
    return {name: [dict(zip(names, row, strict=True)) for row in rows] for name, (names, rows) in want.items()}


def test_report_of_an_archive_without_rows(spark, tmp_path):
    broken = [("a.csv", "time,H01 Count\n1,2\n")]
    assert len(assert_report_equals_batch(spark, [], tmp_path, [1], broken)["schema_errors"]) == 1


def test_quality_report_equals_batch(spark, tmp_path):
    """Zeros that later files mask or make a reset of, a head that a file lacks
    and that comes back with counts it had, a broken file, a pause between files
    and an unreadable time."""
    counts = [
        {"H01": [5, 6, 6, 0, 0], "H02": [5, 6, 7, 8, 0], "H03": [100, 101, 0, 0, 0]},
        {"H01": [0, 0, 0, 0, 9], "H03": [0, 0, 0, 0, 0]},
        {"H01": [9, 10, 0, 0, 0], "H02": [5, 6, 7, 9, 9], "H03": [0, 7, 8, 8, 8]},
        {"H01": [0, 2, 3, 3, 0], "H02": [0, 0, 0, 12, 0]},
    ]
    files, clock = [], 0
    for i, heads in enumerate(counts):
        f = File(f"day{i}.csv")
        for k in range(5):
            clock += 1
            f.rows.append((at(clock), {h: (c[k], 0.0 if k == 1 else 2.0 + k, 77 if (i, k) == (2, 3) else 0) for h, c in heads.items()}))
        clock += 40 * (i == 1)
        files.append(f)
    broken = [("day1b.csv", "time,H01 Count\n1,2\n"), ("day2b.csv", "timestamp,H01 Count,H01 AppTorque,H01 Status,Extra\nnever,1,1,1,1\n")]
    (totals,) = assert_report_equals_batch(spark, files, tmp_path, [1, 2, 4], broken)["quality_totals"]
    assert totals["corrupted_rows_masked_total"] > 0 and totals["duplicate_events_removed_total"] > 0 and totals["boundary_gaps"] > 0


def test_quality_report_of_a_random_archive(spark, tmp_path):
    assert_report_equals_batch(spark, random_archive(5, n_files=4, heads=("H01", "H02", "H03")), tmp_path, [1])


def test_committed_batches_are_not_done_again(spark, tmp_path, monkeypatch):
    files = one_head([1, 2, 3], [4, 6], [7])
    raw, out = write(files, tmp_path / "raw"), str(tmp_path / "out")
    whole, done = streaming.ingest_batch, []

    def failing(s, paths, o, n):
        done.append(n)
        if len(done) == 2:
            raise RuntimeError("lost")
        whole(s, paths, o, n)

    monkeypatch.setattr(streaming, "ingest_batch", failing)
    with pytest.raises(Exception, match="lost"):
        run(spark, raw, out, 1)
    run(spark, raw, out, 1)
    assert done == [0, 1, 1, 2] and streaming.committed(spark, out) == [0, 1, 2]
    assert streaming.stream_events(spark, out).count() == len(expected(files)["events"])
    assert not (tmp_path / "out" / "_stage").exists()


def test_steps_at_once_fail_together(spark):
    assert streaming._at_once(spark, [lambda: 1, lambda: spark.range(3).count()]) == [1, 3]
    with pytest.raises(ZeroDivisionError):
        streaming._at_once(spark, [lambda: 1, lambda: 1 / 0])


def test_cells_of_wide_rows_are_counted_without_unfolding_them(spark, tmp_path):
    files = random_archive(3, n_files=2, heads=("H01", "H02", "H03"))
    rows = cut(readings.with_steps(read_wide_csv(spark, write(files, tmp_path / "raw")).wide))
    repaired = cut(repair(readings.count_changes(rows)))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan(quality.missing_cells(rows, repaired)) and "Expand" not in plan(quality.missing_cells(rows, repaired))
    assert "lambda" not in plan(quality.trailing_zero_rows(rows)) and plan(quality.trailing_zero_rows(rows)).count("Window [") == 1
