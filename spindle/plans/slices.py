"""Ordered computations split into slices of bounded size.

A window partitioned by head alone puts every reading of a head into one task,
and a third of all rows may belong to one head. The helpers here cut the order
axis (time, position or value) at equi-depth points first. A running value is
then computed inside each (key, slice) group, plus a carry taken from a small
table with one row per (key, slice). The result does not depend on where the
cuts fall; they only set how evenly the work is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
MAX_SLICES = 4096
SLICE_ROWS = 250_000
TREE_CUTS = 512
SKETCH_ACCURACY = 10_000
UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
BEFORE_HERE = (Window.unboundedPreceding, -1)


def slice_count(df: DataFrame, rows: int = 0) -> int:
    """As many as keep a slice at SLICE_ROWS rows, and enough for all tasks."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(4, tasks, -(-rows // SLICE_ROWS)), MAX_SLICES)


def slice_bounds(df: DataFrame, axis: str, slices: int | None = None) -> list:
    """Equi-depth cut points of `axis`, from a mergeable sketch of fixed size.

    Rows are counted in the same pass, and their number decides how many of the
    points are used. The points are fetched (at most MAX_SLICES numbers) and
    become literals, so every branch of a plan cuts at the same places.
    """
    points = [i / MAX_SLICES for i in range(1, MAX_SLICES)]
    found = df.agg(F.count(axis).alias("n"), F.percentile_approx(axis, points, SKETCH_ACCURACY).alias("at")).first()
    n = slices or slice_count(df, found["n"])
    return sorted({found["at"][round(i * MAX_SLICES / n) - 1] for i in range(1, n)}) if found["at"] else []


def slice_index(axis: str, bounds: list) -> Column:
    """How many cut points are <= axis, by binary search."""
    if not bounds:
        return F.lit(0)
    suffix = "L" if isinstance(bounds[0], int) else "D"
    if len(bounds) <= TREE_CUTS:
        return F.expr(_decision_tree(axis, [f"{b!r}{suffix}" for b in bounds], 0))
    cuts = F.expr("array(" + ",".join(f"{b!r}{suffix}" for b in bounds) + ")")
    strides = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def step(state, stride):
        there = state["found"] + stride
        go = F.get(cuts, there - F.lit(1)) <= state["at"]
        return F.struct(F.when(go, there).otherwise(state["found"]).alias("found"), state["at"].alias("at"))

    # the axis travels in the state: a lambda that captures an outer column
    # does not survive the filters Spark infers for joins on the result
    start = F.struct(F.lit(0).alias("found"), F.col(axis).alias("at"))
    return F.aggregate(F.array(*[F.lit(s) for s in strides]), start, step, lambda state: state["found"])


def _decision_tree(axis: str, cuts: list[str], below: int) -> str:
    """Nested comparisons, which compile to plain code."""
    if not cuts:
        return str(below)
    middle = len(cuts) // 2
    left = _decision_tree(axis, cuts[:middle], below)
    right = _decision_tree(axis, cuts[middle + 1 :], below + middle + 1)
    return f"CASE WHEN `{axis}` < {cuts[middle]} THEN {left} ELSE {right} END"


def sliced(df: DataFrame, axis: str, slices: int | None = None) -> DataFrame:
    return df.withColumn(SLICE, slice_index(axis, slice_bounds(df, axis, slices)))


def running(
    df: DataFrame,
    keys: list[str],
    order: list,
    sums: dict[str, Column],
    *,
    peers: bool = False,
    totals: bool = False,
) -> DataFrame:
    """Add running sums per key in `order`; `df` must already carry SLICE.

    With `peers`, rows that tie in the order all see the sum including the tie.
    With `totals`, also add `<name>_total`, the sum over the whole key.
    """
    part = [*keys, SLICE]
    per_slice = df.groupBy(*part).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(*BEFORE_HERE)
    whole = Window.partitionBy(*keys)
    carried = []
    for n in sums:
        carried.append(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}"))
        if totals:
            carried.append(F.sum(f"_t_{n}").over(whole).alias(f"{n}_total"))
    carry = per_slice.select(*part, *carried)
    here = Window.partitionBy(*part).orderBy(*order)
    here = here.rangeBetween(*UP_TO_HERE) if peers else here.rowsBetween(*UP_TO_HERE)
    joined = df.join(carry, part)
    return joined.withColumns(
        {n: F.col(f"_b_{n}") + F.coalesce(F.sum(v).over(here), F.lit(0)) for n, v in sums.items()}
    ).drop(*[f"_b_{n}" for n in sums])


def previous_axis(df: DataFrame, keys: list[str], axis: str, out: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add the axis value of the row before this one; `df` must carry SLICE.
    Rows with one axis value lie in one slice and come in the order of `ties`."""
    part = [*keys, SLICE]
    latest = df.groupBy(*part).agg(F.max(axis).alias("_latest"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE)
    carry = latest.select(*part, F.lag("_latest").over(earlier).alias("_carry"))
    here = Window.partitionBy(*part).orderBy(axis, *ties)
    return (
        df.join(carry, part)
        .withColumn(out, F.coalesce(F.lag(axis).over(here), "_carry"))
        .drop("_carry")
    )


def chunked(df: DataFrame, position: str, size: int, halo: int) -> DataFrame:
    """Split dense positions into chunks of `size` rows, each led by a copy of
    the last `halo` rows of the chunk before it (`_halo` marks the copies).

    With size >= halo a window looking back at most `halo` rows can then be
    evaluated inside each chunk.
    """
    if size < halo:
        raise ValueError("a chunk must be at least as long as its halo")
    pos = F.col(position)
    own = F.floor(pos / F.lit(size))
    is_tail = (pos % size) >= (size - halo)
    copies = F.when(is_tail, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_chunk", F.explode(copies)).withColumn("_halo", F.col("_chunk") != own)
