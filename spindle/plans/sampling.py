"""Seeded samples without replacement that any partitioning agrees on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK = 1.5  # of the expected share of candidates
HEX = 8  # hexadecimal digits of the hash that are compared first


def sample_per_group(df: DataFrame, group: str, size: int, key: Column, seed: int = 0) -> DataFrame:
    """Of each group the `size` rows whose keyed hashes are least, all rows of a
    smaller group. `key` tells the rows of a group apart.

    The counts of the groups give a bound on the hash below which a little more
    than `size` rows are expected; only those are ranked, so no group is sorted
    whatever its size. Bounds are doubled where too few rows lie below, so that
    the result is exactly the least hashes. There must be few groups: their
    counts come to the driver.
    """
    drawn = df.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group), key)))
    part = F.conv(F.substring("_hash", 1, HEX), 16, 10).cast("double") / F.lit(float(16**HEX))
    counts = {r[group]: r["n"] for r in df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = {g: min(1.0, (SLACK * size + 10) / n) for g, n in counts.items()}
    while True:
        limit = F.coalesce(*[F.when(F.col(group).eqNullSafe(F.lit(g)), F.lit(b)) for g, b in bounds.items()], F.lit(1.0))
        below = drawn.where(part < limit)
        found = {r[group]: r["n"] for r in below.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [g for g, n in counts.items() if found.get(g, 0) < min(size, n)]
        if not short:
            break
        bounds |= {g: min(1.0, 2 * bounds[g]) for g in short}
    least = F.row_number().over(Window.partitionBy(group).orderBy("_hash"))
    return below.withColumn("_place", least).where(F.col("_place") <= size).drop("_place", "_hash")
