"""Exact quantiles and mid-ranks from a histogram of distinct values.

Rows are first reduced to (key, value, count), which combines on the map side
whatever the skew. A sliced running count over the distinct values then gives
the rank of each of them, so that no task ever holds or sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.plans.slices import SLICE, running, slice_bounds, slice_index
from spindle.session import cut

BANDS_PER_OCTAVE = 16


def histogram(df: DataFrame, keys: list[str], value: str, **counts: Column) -> DataFrame:
    """(keys, value, n) of the values that are not null, computed once. Instead of
    the number of rows, `counts` may name others."""
    columns = counts or {"n": F.count(F.lit(1))}
    named = [column.alias(name) for name, column in columns.items()]
    return cut(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*named))


def duration_band(micros: Column) -> Column:
    """A slice for time steps that needs no look at the data: a sixteenth of an
    octave. Steps are whole microseconds and cannot sum to more than the time
    observed, so a band of a year holds at most some 1.4 million distinct steps."""
    size = F.floor(F.log2(F.abs(micros) + F.lit(1.0)) * BANDS_PER_OCTAVE).cast("int")
    return F.when(micros < 0, -size).otherwise(size)


def ranked_histogram(
    df: DataFrame, group: str, value: str, band: Column | None = None
) -> DataFrame:
    """Histogram rows with `upto`, the number of all rows with a value <= this
    one, and `upto_total`, the number of all rows.

    The values are sliced at equi-depth points of the histogram, whose rows are
    distinct values, unless `band`, a non-decreasing function of the value, is
    given. Repeated values take no room in a slice.
    """
    hist = histogram(df, [group], value)
    hist = hist.withColumn(SLICE, _slices(hist, value, band))
    return running(hist, [], [value], {"upto": F.col("n")}, peers=True, totals=True)


def _slices(hist: DataFrame, value: str, band: Column | None) -> Column:
    return slice_index(value, slice_bounds(hist, value)) if band is None else band


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probabilities: dict[str, float | tuple[float, Column]],
    band: Column | None = None,
) -> DataFrame:
    """One row per key with linearly interpolated quantiles, one column each.

    A probability may come with a condition: the quantile is then taken over the
    rows that meet it. All of them share one histogram.
    """
    everything = F.lit(True)
    asked = {n: p if isinstance(p, tuple) else (p, everything) for n, p in probabilities.items()}
    conditions = list({id(c): c for _, c in asked.values()}.values())
    which = {n: next(i for i, c in enumerate(conditions) if c is asked[n][1]) for n in asked}
    counts = {f"_n{i}": F.count(F.when(c, 1)) for i, c in enumerate(conditions)}
    hist = histogram(df, keys, value, **counts)
    return quantiles_of(hist, keys, value, {n: (p, f"_n{which[n]}") for n, (p, _) in asked.items()}, band)


def quantiles_of(
    hist: DataFrame, keys: list[str], value: str, asked: dict[str, tuple[float, str]], band: Column | None = None
) -> DataFrame:
    """Quantiles from a histogram; each is asked with the column that counts."""
    hist = hist.withColumn(SLICE, _slices(hist, value, band))
    counts = {n: i for i, n in enumerate(dict.fromkeys(n for _, n in asked.values()))}
    sums = {f"_upto{i}": F.col(n) for n, i in counts.items()}
    ranked = running(hist, keys, [value], sums, peers=True, totals=True)
    picks, results = [], []
    for name, (p, n) in asked.items():
        i = counts[n]
        at = F.lit(p) * (F.col(f"_upto{i}_total") - 1)
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col(f"_upto{i}") - F.col(n) <= index) & (index < F.col(f"_upto{i}"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_{name}_part"))
        lo, hi, part = (F.col(f"_{name}_{s}") for s in ("lo", "hi", "part"))
        results.append((lo + (hi - lo) * part).alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *results)


def moments_of(hist: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, count, mean, std, min, max) of the rows that a histogram counts."""
    x, n = F.col(value), F.col("n")
    sums = hist.groupBy(*keys).agg(F.sum("n").alias("count"), (F.sum(x * n) / F.sum("n")).alias("_mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    # one value only: exactly that one, and no spread
    level = F.when(F.col("min") == F.col("max"), F.col("min")).otherwise(F.col("_mean"))
    sums = sums.withColumn("mean", level).drop("_mean")
    off = F.col(value) - F.col("mean")
    around = hist.join(F.broadcast(sums.select(*keys, "mean")), keys) if keys else hist.withColumn("mean", sums.select("mean").scalar())
    squares = around.groupBy(*keys).agg(F.sum(off * off * n).alias("_squares"))
    both = sums.join(squares, keys) if keys else sums.withColumn("_squares", squares.scalar())
    std = F.when(F.col("count") > 1, F.sqrt(F.col("_squares") / (F.col("count") - 1)))
    return both.select(*keys, "count", "mean", std.alias("std"), "min", "max")


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row per group: size `n`, sum of mid-ranks `rank_sum` over the pooled
    values, and the pooled size `n_all` and tie term `ties` on every row."""
    ranked = ranked_histogram(df, group, value)
    tie = Window.partitionBy(SLICE, value)
    t = F.sum("n").over(tie).cast("double")
    n = F.col("n").cast("double")
    per_row = ranked.select(
        group,
        "n",
        F.col("upto_total").alias("n_all"),
        (n * (F.col("upto") - t + (t + 1) / 2)).alias("_ranks"),
        (n * (t * t - 1)).alias("_ties"),
    )
    per_group = per_row.groupBy(group).agg(
        F.sum("n").alias("n"),
        F.sum("_ranks").alias("rank_sum"),
        F.max("n_all").alias("n_all"),
        F.sum("_ties").alias("_ties"),
    )
    everything = Window.partitionBy()  # one row per group: at most MAX_HEAD_IDS
    return per_group.withColumn("ties", F.sum("_ties").over(everything)).drop("_ties")
