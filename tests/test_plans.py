"""The sliced computations against pandas, with cuts at every few rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindle.operators import torque
from spindle.operators.production import tag_idle
from spindle.plans import distribution, slices
from spindle.plans.pairwise import pair_sums, pearson


@pytest.fixture
def many_slices(monkeypatch):
    monkeypatch.setattr(slices, "slice_count", lambda df, rows=0: 23)


@pytest.fixture(scope="module")
def values():
    rng = random.Random(5)
    return pd.DataFrame(
        [(rng.choice("aaab"), i, rng.choice([1.0, 1.5, 2.25, 7.0, rng.random()])) for i in range(400)],
        columns=["head_id", "i", "x"],
    )


def test_slice_index_counts_the_cuts_below(spark):
    df = spark.range(50).withColumn("s", slices.slice_index("id", [3, 10, 11, 40]))
    assert all(r.s == sum(b <= r.id for b in (3, 10, 11, 40)) for r in df.collect())


def test_running_sum_and_previous(spark, values, many_slices):
    df = slices.sliced(spark.createDataFrame(values), "i")
    got = slices.running(df, ["head_id"], ["i"], {"total": F.col("x")}).toPandas().sort_values("i")
    want = values.groupby("head_id")["x"].cumsum()
    assert np.allclose(got["total"], want)
    got = slices.previous_axis(df, ["head_id"], "i", "before").toPandas().sort_values("i")
    want = values.groupby("head_id")["i"].shift()
    assert got["before"].fillna(-1).tolist() == want.fillna(-1).tolist()


def test_exact_quantiles(spark, values, many_slices):
    asked = {"a": 0.25, "b": 0.5, "c": 0.995}
    got = distribution.exact_quantiles(spark.createDataFrame(values), ["head_id"], "x", asked).collect()
    for row in got:
        x = values[values.head_id == row.head_id]["x"]
        assert np.allclose([row.a, row.b, row.c], x.quantile([0.25, 0.5, 0.995]))


def test_median_of_whole_microseconds_in_bands(spark):
    steps = [-5, 0, 1, 2, 1000, 1001, 1003, 60_000_000]
    df = spark.createDataFrame([(s,) for s in steps], "s long")
    band = distribution.duration_band(F.col("s"))
    for part in (steps, steps[:-1]):
        got = distribution.exact_quantiles(df.where(F.col("s").isin(part)), [], "s", {"m": 0.5}, band).first()
        assert got.m == np.median(part)


def test_rank_sums(spark, values, many_slices):
    got = {r.head_id: r for r in distribution.rank_sums(spark.createDataFrame(values), "head_id", "x").collect()}
    ranks = values["x"].rank()
    t = values["x"].value_counts().to_numpy(dtype=float)
    for head, row in got.items():
        assert row.rank_sum == pytest.approx(ranks[values.head_id == head].sum())
        assert row.ties == pytest.approx((t**3 - t).sum())


def test_slices_of_values_of_which_nearly_all_are_equal(spark, many_slices):
    """98 of 100 rows hold one value: cuts by row depth would put all others into
    one slice; cuts of the histogram deal the distinct values out evenly."""
    rows = [(2.0,)] * 9800 + [(2.0 + i / 997,) for i in range(1, 201)]
    df = spark.createDataFrame(rows, "x double")
    ranked = distribution.ranked_histogram(df.withColumn("g", F.lit("a")), "g", "x")
    sizes = [r["count"] for r in ranked.groupBy(slices.SLICE).count().collect()]
    assert sum(sizes) == 201 and max(sizes) <= 2 * 201 / len(sizes)
    top = ranked.where("x > 2").orderBy("x").collect()
    assert [r["upto"] for r in top] == list(range(9801, 10001))


def test_slices_follow_the_number_of_rows_not_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(slices, "SLICE_ROWS", 100)
    times = [int(1000 * (i / 100) ** 3) for i in range(5000)]
    df = slices.sliced(spark.createDataFrame([(t,) for t in times], "t long"), "t")
    sizes = [r["count"] for r in df.groupBy(slices.SLICE).count().collect()]
    assert len(sizes) > 45 and max(sizes) <= 200


def test_moments_of_a_histogram(spark, values):
    extra = pd.DataFrame([("c", i, 0.1) for i in range(7)] + [("d", 0, 5.0)], columns=values.columns)
    rows = pd.concat([values, extra])
    hist = distribution.histogram(spark.createDataFrame(rows), ["head_id"], "x")
    for row in distribution.moments_of(hist, ["head_id"], "x").collect():
        x = rows[rows.head_id == row.head_id]["x"]
        assert (row["count"], row["min"], row["max"]) == (len(x), x.min(), x.max())
        assert row["mean"] == pytest.approx(x.mean()) and (len(x) == 1 and row["std"] is None or row["std"] == pytest.approx(x.std()))
        if row.head_id == "c":
            assert (row["mean"], row["std"]) == (0.1, 0.0)


def test_pairwise_correlation_is_pairwise_complete(spark):
    rng = np.random.default_rng(1)
    cells = [(d, h, float(rng.random())) for d in range(30) for h in "abc" if rng.random() > 0.3]
    cells += [(d, "flat", 0.9) for d in range(30)]
    sums = pair_sums(spark.createDataFrame(cells, "day int, head_id string, x double"), "day", "x")
    r = pearson(*(F.col(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")))
    got = {(x.head_a, x.head_b): x.r for x in sums.select("head_a", "head_b", r.alias("r")).collect()}
    want = pd.DataFrame(cells, columns=["day", "h", "x"]).pivot(index="day", columns="h", values="x").corr()
    for a in "abc":
        assert got[a, "flat"] is None
        for b in "abc":
            assert got[a, b] == pytest.approx(want.loc[a, b])


def events_frame(n=300, seed=3):
    rng = random.Random(seed)
    t = pd.Timestamp("2026-01-01")
    rows, last = [], {}
    for i in range(n):
        t += pd.Timedelta(seconds=rng.choice([1, 5, 600, 4000]))
        h = rng.choice(["H01", "H01", "H02"])
        since = None if h not in last else (t - last[h]).total_seconds()
        last[h] = t
        rows.append((t.to_pydatetime(), h, i, float(rng.choice([2.0, 2.1, rng.random() * 5])), 0, since))
    return rows


EVENTS = "timestamp timestamp_ntz, head_id string, counter long, torque_nm double, status_code int, time_since_last_closure double"


def test_latest_intervals_against_merge_asof(spark, many_slices):
    rows = events_frame()
    starts = [r[0] for r in rows[10::37]]  # intervals that begin and end at events
    ends = [r[0] for r in rows[13::37]][: len(starts)]
    idle = spark.createDataFrame(list(zip(starts, ends)), "start_time timestamp_ntz, end_time timestamp_ntz")
    got = tag_idle(spark.createDataFrame(rows, EVENTS), idle).toPandas().sort_values("counter")
    for row, inside, crosses in zip(rows, got["in_idle"], got["crosses_idle"]):
        at, since = row[0], row[5]
        opened = [i for i, s in enumerate(starts) if s <= at]
        assert inside == (bool(opened) and at <= ends[opened[-1]])
        closed = [e for e in ends if e <= at]
        before = None if since is None else pd.Timestamp(at) - pd.Timedelta(seconds=since)
        assert crosses == (bool(closed) and before is not None and before <= closed[-1] < at)


@pytest.mark.parametrize("window", [7, 40, "2h"])
def test_rolling_and_changepoints_against_pandas(spark, many_slices, monkeypatch, window):
    monkeypatch.setattr(torque, "CHUNK_ROWS", 60)
    rows = events_frame()
    df = spark.createDataFrame(rows, EVENTS)
    got = torque.torque_rolling(df, window).toPandas().sort_values("counter")
    jumps = sorted((r.head_id, r.timestamp) for r in torque.torque_changepoints(df, window).collect())
    want_jumps = []
    frame = pd.DataFrame(rows, columns=["ts", "head", "i", "x", "s", "d"])
    for head, part in frame.groupby("head"):
        series = part.set_index("ts")["x"]
        roll = series.rolling(window) if isinstance(window, str) else series.rolling(window, min_periods=max(2, window // 10))
        mean, std = roll.mean(), roll.std()
        mine = got[got.head_id == head]
        assert np.allclose(mine["moving_avg"].astype(float), mean, equal_nan=True)
        assert np.allclose(mine["moving_std"].astype(float), std, equal_nan=True, atol=1e-7)
        lag = max(10, window // 10) if isinstance(window, int) else 10
        jump = (mean.diff(lag).abs() > 2 * series.std()).to_numpy()
        first = jump & ~np.r_[False, jump[:-1]]
        want_jumps += [(head, t.to_pydatetime()) for t in series.index[first]]
    assert jumps == sorted(want_jumps)


def test_no_window_over_raw_rows_runs_in_one_task(spark, values):
    """Unpartitioned windows only ever see tables with one row per slice."""
    df = slices.sliced(spark.createDataFrame(values), "i")
    plan = slices.running(df, [], ["i"], {"total": F.col("x")})._jdf.queryExecution().executedPlan().toString()
    for window in [line for line in plan.splitlines() if " Window [" in line]:
        assert "_slice" in window
