"""Sums over pairs of heads, for correlation matrices."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# executors get these functions by value and need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = "head_a string, head_b string, n double, sa double, sb double, saa double, sbb double, sab double"
RELATIVE_ZERO = 1e-12


def pair_sums(cells: DataFrame, bucket: str, value: str) -> DataFrame:
    """For every two heads, the moments of `value` over the buckets where both
    have one. `cells` holds one row per (bucket, head_id).

    Each task multiplies the matrix of its own buckets with itself, so it emits
    one row per pair of heads however many buckets it holds.
    """
    vectors = cells.groupBy(bucket).agg(
        F.collect_list("head_id").alias("heads"),  # at most MAX_HEAD_IDS entries
        F.collect_list(value).alias("values"),
    )
    partial = vectors.select("heads", "values").mapInPandas(_gram, GRAM)
    sums = [F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]
    return partial.groupBy("head_a", "head_b").agg(*sums)


def _gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        names, column = np.unique(np.concatenate(batch["heads"].to_numpy()), return_inverse=True)
        row = np.repeat(np.arange(len(batch)), batch["heads"].str.len())
        x = np.zeros((len(batch), len(names)))
        seen = np.zeros_like(x)
        x[row, column] = np.concatenate(batch["values"].to_numpy()).astype(float)
        seen[row, column] = 1.0
        a, b = np.meshgrid(np.arange(len(names)), np.arange(len(names)), indexing="ij")
        sums = {
            "n": seen.T @ seen,
            "sa": x.T @ seen,
            "sb": seen.T @ x,
            "saa": (x * x).T @ seen,
            "sbb": seen.T @ (x * x),
            "sab": x.T @ x,
        }
        yield pd.DataFrame(
            {"head_a": names[a.ravel()], "head_b": names[b.ravel()]}
            | {k: v.ravel() for k, v in sums.items()}
        )


def pearson(n: Column, sa: Column, sb: Column, saa: Column, sbb: Column, sab: Column) -> Column:
    """Correlation from moments; null without variation on either side."""
    va, vb = saa - sa * sa / n, sbb - sb * sb / n
    varies = (va > RELATIVE_ZERO * saa) & (vb > RELATIVE_ZERO * sbb)
    return F.when(varies, (sab - sa * sb / n) / F.sqrt(va * vb))


def head_pairs(heads: DataFrame) -> DataFrame:
    """All ordered pairs of at most MAX_HEAD_IDS heads; none for a single head."""
    listed = heads.agg(F.collect_set("head_id").alias("_heads")).where(F.size("_heads") >= 2)
    return listed.select(F.explode("_heads").alias("head_a"), "_heads").select(
        "head_a", F.explode("_heads").alias("head_b")
    )
