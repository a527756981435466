"""Stored tables: what an ingest leaves behind and the analyses start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.constants import EVENT_COLUMNS, EVENT_SCHEMA, IDLE_SCHEMA
from spindle.session import configure, workspace
from spindle.sources.folders import children, replaced

CLOSURE_EVENTS = "closure_events.parquet"
IDLE_PERIODS = "idle_periods.parquet"
HOURLY_CELLS = "hourly_cells.parquet"
TORQUE_SKETCHES = "torque_sketches.parquet"
QUALITY = "data_quality"
EVENT_DATE = "event_date"
OLD_NAMES = {"accepted_closure_count": "inferred_closure_count"}


def _read(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """`path` is the table itself or the folder it lies in. A table without rows
    may have no file that shows its schema."""
    reader = configure(spark).read
    inside = f"{path.rstrip('/')}/{name}"
    for place in (inside, path):
        try:
            return reader.parquet(place)
        except AnalysisException as error:
            if error.getCondition() == "UNABLE_TO_INFER_SCHEMA" and place == inside:
                return reader.schema(schema).parquet(place)
            if error.getCondition() != "PATH_NOT_FOUND" or place == path:
                raise


def load_closure_events(spark: SparkSession, path: str) -> DataFrame:
    events = _read(spark, path, CLOSURE_EVENTS, T.StructType([*EVENT_SCHEMA, T.StructField(EVENT_DATE, T.DateType())]))
    if "inferred_closure_count" not in events.columns:
        events = events.withColumnsRenamed(OLD_NAMES)
    return events


def load_idle_periods(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, IDLE_PERIODS, IDLE_SCHEMA)


def load_quality_report(spark: SparkSession, folder: str, name: str = "quality_totals") -> DataFrame | None:
    """One table of the quality report, or None if there is no report."""
    try:
        return configure(spark).read.json(f"{folder.rstrip('/')}/{QUALITY}/{name}")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def write_closure_events(events: DataFrame, folder: str, name: str = CLOSURE_EVENTS, mode: str = "overwrite") -> str:
    """Parquet, one folder per day. Rows are rebalanced by day first: at run time
    Spark splits a day with very many events and joins small ones, so that files
    come out at the advisory size. A table that is overwritten stays readable
    until the new one is whole."""
    path = f"{folder.rstrip('/')}/{name}"
    dated = events.select(*EVENT_COLUMNS).withColumn(EVENT_DATE, F.to_date("timestamp"))
    ordered = dated.hint("rebalance", EVENT_DATE).sortWithinPartitions(EVENT_DATE, "timestamp", "head_id")
    return _put(
        events.sparkSession,
        path,
        mode,
        lambda to: ordered.write.mode(mode).option("compression", "zstd").partitionBy(EVENT_DATE).parquet(to),
    )


def _put(spark: SparkSession, path: str, mode: str, write: Callable[[str], object]) -> str:
    if mode == "overwrite":
        return replaced(spark, path, write)
    write(path)
    return path


def write_idle_periods(idle: DataFrame, folder: str, name: str = IDLE_PERIODS, mode: str = "overwrite") -> str:
    path = f"{folder.rstrip('/')}/{name}"
    return _put(idle.sparkSession, path, mode, lambda to: idle.write.mode(mode).parquet(to))


def write_hourly_cells(cells: DataFrame, folder: str) -> str:
    """One file in order of hours for each task that has some, so that a range
    reads few row groups."""
    path = f"{folder.rstrip('/')}/{HOURLY_CELLS}"
    ordered = cells.repartitionByRange("hour").sortWithinPartitions("hour")
    return replaced(cells.sparkSession, path, lambda to: ordered.write.option("compression", "zstd").parquet(to))


def load_hourly_cells(spark: SparkSession, folder: str) -> DataFrame | None:
    """The cells that an ingest stored beside the events, if it did."""
    path = f"{folder.rstrip('/')}/{HOURLY_CELLS}"
    return configure(spark).read.parquet(path) if children(spark, path) else None


def write_torque_sketches(sketches: DataFrame, folder: str) -> str:
    path = f"{folder.rstrip('/')}/{TORQUE_SKETCHES}"
    ordered = sketches.repartitionByRange("day").sortWithinPartitions("day")
    return replaced(sketches.sparkSession, path, lambda to: ordered.write.option("compression", "zstd").parquet(to))


def load_torque_sketches(spark: SparkSession, folder: str) -> DataFrame | None:
    """The sketches that an ingest stored beside the events, if it did."""
    path = f"{folder.rstrip('/')}/{TORQUE_SKETCHES}"
    return configure(spark).read.parquet(path) if children(spark, path) else None


def write_json_tables(tables: dict[str, DataFrame], folder: str) -> str:
    """Each table as a folder of JSON lines; not-a-number becomes null. A table
    that is there already stays until the new one is whole."""
    for name, table in tables.items():
        doubles = {c: F.when(~F.isnan(c), F.col(c)) for c, kind in table.dtypes if kind == "double"}
        clean = table.withColumns(doubles) if doubles else table
        write = lambda to, clean=clean: clean.write.option("ignoreNullFields", "false").json(to)
        replaced(table.sparkSession, f"{folder.rstrip('/')}/{name}", write)
    return folder


def write_quality_tables(tables: dict[str, DataFrame], folder: str) -> str:
    return write_json_tables(tables, f"{folder.rstrip('/')}/{QUALITY}")


def write_analytics_tables(tables: dict[str, DataFrame], folder: str) -> str:
    return write_json_tables(tables, f"{folder.rstrip('/')}/analytics")


_WRITTEN: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, origin: str, name: str, write: Callable[[str], object]) -> str:
    """The folder of a derived result, written once per session below the
    checkpoint folder."""
    key = (spark.sparkContext.applicationId, origin, name)
    if key not in _WRITTEN:
        path = workspace(spark, name)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def stored(spark: SparkSession, origin: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per session.

    Analyses run on stored tables, as they do after an ingest: it cuts the
    lineage of the derivation and lets them prune columns and push filters.
    """
    write = lambda path: build().write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(once(spark, origin, name, write))
