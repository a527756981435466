"""Queries over the sample tables, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DECIMALS = 6
NUDGE = 1e-9  # decides halves such as 0.0000005, which a last-bit difference would split


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, the precision at which two engines that add in
    different orders agree."""
    doubles = {c: F.round(F.col(c) + F.lit(NUDGE), DECIMALS) + F.lit(0.0) for c, kind in df.dtypes if kind == "double"}
    return df.withColumns(doubles) if doubles else df


def register(name: str, run: Query, views: str = "", body: str = "", doubles: str = "") -> None:
    """Add a query; `body` is its SQL over the `views`, and `doubles` names the
    columns to round."""
    QUERIES[name] = lambda spark, folder: rounded(run(spark, folder))
    if not body:
        return
    if doubles:
        tidy = ", ".join(f'round(CAST({c} AS DOUBLE) + {NUDGE}, {DECIMALS}) + 0.0 AS {c}' for c in doubles.split())
        body = f"SELECT * REPLACE ({tidy}) FROM ({body})"
    ORACLE[name] = f"WITH {views.strip()}\n{body}" if views else body
