"""Small helpers of the corpus operators: inputs, staged tables, vectors."""

from __future__ import annotations

import atexit
import sys
from collections.abc import Callable
from types import ModuleType

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.session import workspace

_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table below the shared checkpoint folder and read it back.

    It cuts the lineage: a lost executor costs no more than the running step.
    `release` deletes what was staged, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder that `release` deletes."""
    path = workspace(spark, name)
    _STAGED.append((spark, path))
    return path


def release() -> None:
    """Delete the staged tables. Results that read them must be consumed first."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            java = spark._jvm.org.apache.hadoop.fs.Path(path)
            java.getFileSystem(spark._jsc.hadoopConfiguration()).delete(java, True)
        except Exception:  # the session may be gone when the driver ends
            return


atexit.register(release)


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """An object that outlives the task: functions are pickled by value, so their
    module starts anew in every task, while a Python worker serves many."""
    store = sys.modules.setdefault("spindle_kept", ModuleType("spindle_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def usable_vector(vector: Column) -> Column:
    """Not null, not empty, and every component present and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def vectors_of(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector) of the rows that can be compared. Rows repeating an id
    count once, with the least of their vectors; rows without an id are left out."""
    return (
        df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
        .where(F.col("vec_id").isNotNull() & usable_vector(F.col("vector")))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )


def packed(vectors) -> list[bytes]:
    """Rows of doubles as bytes: a binary column crosses to Python without a
    list per row."""
    return [np.asarray(v, dtype=np.float64).tobytes() for v in vectors]


def unpacked(values, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.float64).reshape(-1, dim)
