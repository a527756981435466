"""Approximate quantiles against exact ranks, whatever the order and the skew."""

import datetime
import random

import numpy as np
import pytest

from spindle.operators.sketches import RANK_ERROR, approximate_quantiles, daily_sketches, rank_errors
from spindle.sources.tables import load_torque_sketches, write_torque_sketches

EVENTS = "timestamp timestamp_ntz, head_id string, torque_nm double, status_code int"
START = datetime.datetime(2026, 3, 1)


@pytest.fixture(scope="module")
def readings():
    rng, rows = random.Random(5), []
    for i in range(30_000):
        head = "H01" if i % 3 else rng.choice(["H02", "H03"])  # one head holds two thirds
        at = START + datetime.timedelta(minutes=i * 0.2 if head != "H03" else 7 * 1440 - i * 0.2)
        torque = 2.0 if head == "H02" and i % 10 else rng.lognormvariate(0.5, 0.6) + i / 20_000
        rows.append((at, head, torque, 0))
    odd = [(START, "H01", None, 0), (START, "H01", float("nan"), 0), (START, "H02", 99.0, 2), (START, "H04", 5.0, 2), (START, "H05", 1.5, 0)]
    return rows + odd


def usable(rows, head=None, days=None):
    return np.array([t for at, h, t, s in rows if s == 0 and t is not None and t == t and head in (None, h) and (not days or days[0] <= at.date() <= days[1])])


def off(values, quantile, p):
    return max((values < quantile).mean() - p, p - (values <= quantile).mean(), 0.0)


def test_quantiles_of_heads_keep_the_bound_for_any_range_of_days(spark, readings):
    events = spark.createDataFrame(readings, EVENTS).repartition(6)
    sketched = daily_sketches(events)
    for days in (None, (datetime.date(2026, 3, 2), datetime.date(2026, 3, 3)), ("2026-03-04", "2026-03-04")):
        found = approximate_quantiles(sketched, days=days).collect()
        span = days and tuple(datetime.date.fromisoformat(str(d)) for d in days)
        assert {r["head_id"] for r in found} == {h for h in ("H01", "H02", "H03", "H05") if len(usable(readings, h, span))}
        for r in found:
            values = usable(readings, r["head_id"], span)
            assert r["n_observations"] == len(values)
            assert all(off(values, r[name], p) <= RANK_ERROR for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))


def test_groups_heads_and_other_probabilities(spark, readings):
    sketched = daily_sketches(spark.createDataFrame(readings, EVENTS))
    tails = {"p01": 0.01, "p99": 0.99}
    (whole,) = approximate_quantiles(sketched, "overall", probabilities=tails).collect()
    values = usable(readings)
    assert whole["n_observations"] == len(values) and all(off(values, whole[k], p) <= RANK_ERROR for k, p in tails.items())
    daily = approximate_quantiles(sketched, "daily", heads=["H03"]).collect()
    assert {r["day"] for r in daily} == {at.date() for at, h, *_ in readings if h == "H03"}
    with pytest.raises(ValueError):
        approximate_quantiles(sketched, "weekly")


def test_errors_are_measured_and_few_readings_are_exact(spark, readings):
    events = spark.createDataFrame(readings, EVENTS)
    errors = {r["head_id"]: r for r in rank_errors(events, approximate_quantiles(daily_sketches(events))).collect()}
    assert set(errors) == {"H01", "H02", "H03", "H05"} and errors["H05"]["largest_error"] == 0
    assert all(r["largest_error"] <= RANK_ERROR for r in errors.values())
    wrong = approximate_quantiles(daily_sketches(events)).selectExpr("head_id", "q3 AS q1", "median", "q1 AS q3")
    assert {r["head_id"]: r["largest_error"] for r in rank_errors(events, wrong).collect()}["H01"] == pytest.approx(0.5, abs=RANK_ERROR)


def test_stored_sketches_and_none(spark, readings, tmp_path):
    events = spark.createDataFrame(readings, EVENTS)
    assert load_torque_sketches(spark, str(tmp_path)) is None
    write_torque_sketches(daily_sketches(events), str(tmp_path))
    stored = load_torque_sketches(spark, str(tmp_path))
    assert stored.count() == daily_sketches(events).count()
    assert approximate_quantiles(stored, "overall").first()["n_observations"] == len(usable(readings))
    nothing = daily_sketches(events.limit(0))
    assert nothing.count() == 0 and approximate_quantiles(nothing, "overall").count() == 0 and approximate_quantiles(nothing).count() == 0
