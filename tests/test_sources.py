import pytest
from machine import File, at, write
from pyspark.sql import functions as F

from spindle.operators.filters import filter_events
from spindle.sources import raw_csv, samples, tables

SMALL = "/root/testdata/sf0.001"


def two_heads(name, start):
    return File(name, [(at(start + i), {"H01": (10 + i, 1.0, 0), "H02": (20 + i, 2.0, 9)}) for i in range(5)])


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    first, second = two_heads("a.csv", 0), two_heads("b.csv", 100)
    write([first], tmp_path)
    (tmp_path / "b.csv").write_text(second.csv(heads=["H02", "H01"]))
    rows = raw_csv.read_wide_csv(spark, str(tmp_path)).wide.collect()
    assert len(rows) == 10
    assert all(r["H01 Status"] == 0 and r["H02 Status"] == 9 and r["H02 Count"] == r["H01 Count"] + 10 for r in rows)


def test_rows_keep_their_order_over_scan_splits(spark, tmp_path):
    f = File("a.csv", [(at(0), {"H01": (i, 1.0, 0)}) for i in range(300)])
    write([f], tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = raw_csv.read_wide_csv(spark, str(tmp_path)).wide
        assert rows.select("block").distinct().count() > 5
        assert [r["H01 Count"] for r in rows.orderBy("block", "row_id").collect()] == list(range(300))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_discovery_follows_folders(spark, tmp_path):
    for name in ("a/z.csv", "a-b/a.csv", "b.csv", "b.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("timestamp\n")
    found = raw_csv.discover_raw_files(spark, str(tmp_path)).orderBy("position").collect()
    assert [r.path.split(str(tmp_path) + "/")[1] for r in found] == ["a/z.csv", "a-b/a.csv", "b.csv"]
    single = raw_csv.discover_raw_files(spark, str(tmp_path / "b.txt")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in single] == ["b.txt"]


def test_no_files_is_an_error(spark, tmp_path):
    for path in (tmp_path, tmp_path / "missing"):
        with pytest.raises(FileNotFoundError):
            raw_csv.discover_raw_files(spark, str(path))


def test_schema_checks(spark, tmp_path):
    texts = {
        "good.csv": "timestamp,H01 Count,H01 AppTorque,H01 Status\n2026-01-01T00:00:00.000,1,2.0,0\n",
        "no_time.csv": "time,H01 Count,H01 AppTorque,H01 Status\n1,1,2,0\n",
        "no_head.csv": "timestamp,H01 Count,H01 Status\n2026-01-01T00:00:00.000,1,0\n",
        "partial.csv": "timestamp,H01 Count,H01 AppTorque,H01 Status,H02 Count,Extra\nnot a time,1,2.0,0,5,x\n",
        "blank.csv": "\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    archive = raw_csv.read_wide_csv(spark, str(tmp_path))
    assert {r.file for r in archive.errors.collect()} == {"no_time.csv", "no_head.csv", "blank.csv"}
    warned = {r.file: (r.n_unmatched_columns, r.incomplete_heads) for r in archive.warnings.collect()}
    assert warned["partial.csv"] == (1, "H02") and "good.csv" not in warned
    assert archive.wide.count() == 1
    assert [r.bad_timestamps for r in archive.bad_timestamps.collect()] == [1]


def test_stored_events_prune_days_and_push_filters(spark, tmp_path):
    events = samples.closure_events(spark, SMALL)
    tables.write_closure_events(events, str(tmp_path))
    stored = tables.load_closure_events(spark, str(tmp_path))
    assert stored.count() == events.count()
    assert not list(tmp_path.glob("**/_temporary"))
    week = filter_events(stored, ["H01"], ("2024-01-08", "2024-01-09")).agg(F.avg("torque_nm"))
    plan = week._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "EqualTo(head_id,H01)" in plan or "In(head_id" in plan
    assert "ReadSchema: struct<timestamp:timestamp_ntz,head_id:string,torque_nm:double>" in plan


def test_empty_tables_keep_their_schema(spark, tmp_path):
    events = samples.closure_events(spark, SMALL).limit(0)
    tables.write_closure_events(events, str(tmp_path))
    tables.write_idle_periods(samples.idle_intervals(spark, SMALL).limit(0), str(tmp_path))
    assert tables.load_idle_periods(spark, str(tmp_path)).count() == 0
    assert tables.load_quality_report(spark, str(tmp_path)) is None


def test_json_has_null_for_not_a_number(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "i int, x double")
    tables.write_json_tables({"t": df}, str(tmp_path))
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("*.json"))
    assert '{"i":1,"x":null}' in text and '{"i":2,"x":0.5}' in text


def test_every_header_is_read_once(spark, tmp_path, monkeypatch):
    """Errors, warnings and the groups of files come from one look at each file."""
    paths = [tmp_path / f"day{i}.csv" for i in range(3)]
    for path in paths[:2]:
        path.write_text("timestamp,H01 Count,H01 AppTorque,H01 Status\n2026-01-01T00:00:00,1,1,0\n")
    paths[2].write_text("time,H01 Count\n1,2\n")
    opened, look = str(tmp_path / "opened"), raw_csv._first_line

    def counted(path):
        with open(opened, "a") as log:
            log.write(path + "\n")
        return look(path)

    monkeypatch.setattr(raw_csv, "_first_line", counted)
    archive = raw_csv.read_wide_csv(spark, [f"file://{p}" for p in paths])
    assert [r.file for r in archive.errors.collect()] == ["day2.csv"] and archive.warnings.count() == 1
    assert archive.wide.count() == 2
    with open(opened) as log:
        assert sorted(log) == sorted(f"file://{p}\n" for p in paths)
