"""Hourly cells against the analyses of single events, and how often the events
are read."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindle.operators import anomaly, dashboard, failures, heads, production, rollup, summary
from spindle.operators.events import derive_speed, enrich_status
from spindle.operators.filters import filter_events

BLOCK = "timestamp timestamp_ntz, head_id string, counter long, inferred_closure_count long, data_quality string, torque_nm double, status_code int, source_file string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    at, rows = pd.Timestamp("2026-01-01 05:00"), []
    for i in range(900):
        at += pd.Timedelta(milliseconds=rng.choice([0, 700, 5000, 60_000, 900_000]))
        head = rng.choice(["H01", "H01", "H02", "H03"])
        torque = 0.1 if head == "H03" else rng.choice([None, rng.gauss(2, 0.1), 9.0 if i % 90 == 0 else 2.0])
        rows.append((at.to_pydatetime(), head, i, rng.choice([1, 1, 3]), rng.choice(["single", "gap", "aggregated"]), torque, rng.choice([0] * 8 + [2, 9, 65, 4, 77, None]), "a.csv"))
    folder = tmp_path_factory.mktemp("rollup")
    derive_speed(enrich_status(spark.createDataFrame(rows, BLOCK))).write.parquet(str(folder / "events"))
    starts = [r[0] for r in rows[20::70]]
    ends = [max(s, e) for s, e in zip(starts, [r[0] for r in rows[26::70]], strict=False)]
    idle = spark.createDataFrame(list(zip(starts, ends, strict=False)), "start_time timestamp_ntz, end_time timestamp_ntz").withColumn("duration_seconds", F.lit(1.0))
    events = spark.read.parquet(str(folder / "events"))
    rollup.hourly_cells(events, idle).write.parquet(str(folder / "cells"))
    return events, idle, spark.read.parquet(str(folder / "cells"))


def plain(df):
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


RANGES = {
    "whole": None,
    "cut hours": ("2026-01-01 07:12:30", "2026-01-02 03:47:00"),
    "full hours": ("2026-01-01 07:00:00", "2026-01-01 19:59:59.999999"),
    "inside one hour": ("2026-01-01 09:10:00", "2026-01-01 09:40:00"),
    "one cut end": ("2026-01-01 07:00:00", "2026-01-01 20:00:00"),
}


@pytest.mark.parametrize("name", RANGES)
def test_cells_give_what_events_give(tables, name):
    events, idle, stored = tables
    span = RANGES[name]
    cells = dashboard.cells_of(events, idle, span, stored)
    chosen = filter_events(events, None, span)
    produced = production.production(chosen, idle)
    pairs = [
        (rollup.dataset_summary(cells), summary.dataset_summary(chosen)),
        (rollup.head_comparison(cells), heads.head_comparison(chosen)),
        (rollup.production_hours(cells), production._hourly(produced)),
        (rollup.head_speed(cells), production.head_speed(produced)),
        (rollup.head_bounds(cells), anomaly.head_bounds(chosen, "zscore")),
        (rollup.daily_failure_spikes(cells), failures.daily_failure_spikes(chosen)),
        (rollup.failure_correlation(cells), failures.failure_correlation(chosen)),
        *[(rollup.success_rate(cells, g), summary.success_rate(chosen, g)) for g in ("overall", "per_head", "hourly")],
    ]
    for got, want in pairs:
        assert plain(got.select(*want.columns)) == plain(want)


def test_constant_torque_has_no_deviation(tables):
    events, idle, stored = tables
    bounds = {r["head_id"]: (r["lower"], r["upper"]) for r in rollup.head_bounds(stored).collect()}
    assert bounds["H03"] == (0.1, 0.1)


def counted(events, total):
    """The events, and a function that tells how often all of them were read."""
    seen = events.sparkSession.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return events.mapInArrow(pass_on, events.schema), lambda: seen.value / total


def test_how_often_the_events_are_read(tables):
    events, idle, stored = tables
    total = events.count()
    runs = {
        "dashboard": (3, lambda e: dashboard.kpi_dashboard(e, idle).collect()),
        "dashboard from stored cells": (1, lambda e: dashboard.kpi_dashboard(e, idle, cells=stored).collect()),
        "head comparison report": (1, lambda e: [t.collect() for t in dashboard.report_head_comparison(e, stored).values()]),
        "kpi report": (2, lambda e: [t.collect() for t in dashboard.report_kpi(e, idle, stored).values()]),
        "rates": (0, lambda e: rollup.success_rate(stored, "daily").collect()),
        "failure correlation": (0, lambda e: rollup.failure_correlation(stored).collect()),
    }
    for name, (most, run) in runs.items():
        watched, passes = counted(events, total)
        run(watched)
        assert passes() <= most, name
