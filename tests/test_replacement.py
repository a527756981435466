"""Tables that are written anew, and samples."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spindle.constants import EVENT_SCHEMA
from spindle.plans import sampling
from spindle.plans.sampling import sample_per_group
from spindle.sources import tables


def fails():
    return F.raise_error(F.lit("lost midway"))


def some_events(spark, n):
    rows = [(datetime(2026, 1, 1) + timedelta(hours=i), "H01", i) for i in range(n)]
    few = spark.createDataFrame(rows, "timestamp timestamp_ntz, head_id string, counter long")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA if f.name not in few.columns]
    return few.select("*", *empty).select(*EVENT_SCHEMA.fieldNames())


def test_a_write_that_fails_midway_leaves_the_old_table(spark, tmp_path):
    out = str(tmp_path)
    tables.write_closure_events(some_events(spark, 30), out)
    lost = some_events(spark, 50).withColumn("counter", F.when(F.col("counter") < 40, F.col("counter")).otherwise(fails().cast("long")))
    with pytest.raises(Exception, match="lost midway"):
        tables.write_closure_events(lost, out)
    assert tables.load_closure_events(spark, out).count() == 30
    tables.write_closure_events(some_events(spark, 12), out)
    assert tables.load_closure_events(spark, out).count() == 12
    assert [p.name for p in tmp_path.iterdir()] == [tables.CLOSURE_EVENTS]


def test_json_tables_are_replaced_one_by_one(spark, tmp_path):
    out = str(tmp_path)
    tables.write_quality_tables({"a": spark.range(3), "b": spark.range(4)}, out)
    with pytest.raises(Exception, match="lost midway"):
        tables.write_quality_tables({"a": spark.range(5), "b": spark.range(4).select(fails().alias("id"))}, out)
    assert [tables.load_quality_report(spark, out, name).count() for name in "ab"] == [5, 4]
    assert tables.load_quality_report(spark, out, "c") is None


def test_idle_periods_can_be_read_while_they_are_replaced(spark, tmp_path):
    idle = spark.createDataFrame([(datetime(2026, 1, 1), datetime(2026, 1, 2), 1.0)], "start_time timestamp_ntz, end_time timestamp_ntz, duration_seconds double")
    tables.write_idle_periods(idle, str(tmp_path))
    again = tables.load_idle_periods(spark, str(tmp_path))
    tables.write_idle_periods(again.union(again), str(tmp_path))  # reads the table it replaces
    assert tables.load_idle_periods(spark, str(tmp_path)).count() == 2


def test_samples_are_the_least_hashes_however_rows_lie(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaab"), i) for i in range(3000)] + [("c", 9000), (None, 9001)]
    df = spark.createDataFrame(rows, "g string, i long")
    draw = lambda d, seed: sorted(map(tuple, sample_per_group(d, "g", 40, F.col("i").cast("string"), seed).collect()), key=repr)
    first = draw(df, 1)
    assert [sum(g == name for g, _ in first) for name in ("a", "b", "c", None)] == [40, 40, 1, 1]
    assert first == draw(df.repartition(9), 1) and first != draw(df, 2)


def test_a_bound_that_is_too_low_is_doubled(spark, monkeypatch):
    df = spark.range(2000).select(F.lit("a").alias("g"), F.col("id").alias("i"))
    want = sorted(map(tuple, sample_per_group(df, "g", 100, F.col("i").cast("string")).collect()))
    monkeypatch.setattr(sampling, "SLACK", 0.0)
    assert sorted(map(tuple, sample_per_group(df, "g", 100, F.col("i").cast("string")).collect())) == want
