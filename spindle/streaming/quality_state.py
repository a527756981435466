"""The quality report of a stream, batch by batch.

Files are read whole in one batch, so what concerns one file alone (medians,
moments, statuses, gaps inside it) is final when its batch is done and is kept as
rows per file. Three figures look beyond a file and merge: a run of zeros that is
open at the end of a batch is masked, or turns into a reset, when a later count
decides it, and then counts for the file it lies in; the pause before the first
file of a batch needs the last row of the batch before; and events that repeat
earlier ones are counted as they are dropped. Every batch keeps its tables under
its own number, and the report folds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.operators import quality, readings
from spindle.operators.ingest import quality_report, repair
from spindle.sources.folders import children
from spindle.sources.raw_csv import RawArchive, empty_rows

FOLDER = "_quality"
SCHEMA = ("schema_errors", "schema_warnings", "bad_timestamps")


def write_schema(archive: RawArchive, write) -> None:
    """What the headers and timestamps of a batch's files say."""
    for name, table in zip(SCHEMA, (archive.errors, archive.warnings, archive.bad_timestamps), strict=True):
        write(table, f"{FOLDER}/{name}")


def file_tables(rows: DataFrame, settled: DataFrame, last_file: str | None) -> dict[str, DataFrame]:
    """The tables per file of a batch: what masks, and resets that are certain,
    as far as known by now. `rows` and `settled` lack the rows of the state;
    `last_file` is the file before the first one."""
    tables = quality.report_tables(rows, settled)
    gaps = tables["boundary_gaps"]
    before = F.when(F.col("prev_file") != "", F.col("prev_file")).otherwise(F.lit(last_file).cast("string"))
    tables["boundary_gaps"] = gaps.withColumn("prev_file", before)
    certain = F.when(~F.col("is_open"), F.col("counter_delta"))
    tables["file_counter_resets"] = quality.file_counter_resets(settled.withColumn("counter_delta", certain))
    return tables


def fates(settled: DataFrame, waiting: DataFrame | None, state_file: str) -> DataFrame:
    """(head_id, masked) of the runs of zeros that were open before the batch and
    are decided by it: the state stands for such a run as one zero."""
    zero = (F.col("source_file") == state_file) & (F.col("count") == 0) & ~F.col("is_open")
    decided = settled.where(zero).select("head_id", "masked")
    return decided if waiting is None else decided.unionByName(waiting)


def open_rows(settled: DataFrame) -> DataFrame:
    """(head_id, source_file, n): raw rows of this batch inside open runs."""
    return quality.zero_rows(settled, F.col("is_open"), "head_id", "source_file")


def late_masks(pending: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of earlier files that turn out to be masked, per file, and those that
    are still open."""
    known = pending.join(F.broadcast(decided), "head_id", "left")  # a row per head
    late = known.where("masked").groupBy("source_file").agg(F.sum("n").alias("n"))
    return late, known.where("masked IS NULL").drop("masked")


def _batches(spark: SparkSession, output: str, name: str) -> DataFrame | None:
    path = f"{output.rstrip('/')}/{FOLDER}/{name}"
    return spark.read.parquet(path).drop("batch") if children(spark, path) else None


def _folded(spark: SparkSession, output: str, still_open: DataFrame) -> dict[str, DataFrame]:
    """The tables per file of all batches; `still_open` holds the resets that
    open runs are taken for at the end."""
    if _batches(spark, output, "file_quality") is None:
        rows = readings.with_steps(empty_rows(spark))
        return quality.report_tables(rows, repair(readings.count_changes(rows)))
    names = ("file_quality", "missing_cells", "trailing_zero_rows", "sampling_gaps", "boundary_gaps", "invalid_torque", "status_distribution", "file_counter_resets")
    tables = {name: _batches(spark, output, name) for name in names}
    late = _batches(spark, output, "late_masks")
    if late is not None:
        added = late.groupBy("source_file").agg(F.sum("n").alias("_late"))
        more = F.coalesce("_late", F.lit(0))
        cells = tables["missing_cells"].join(added, "source_file", "left")
        for count in ("missing_cells", "masked_counts"):
            cells = cells.withColumn(count, F.col(count) + more)
        tables["missing_cells"] = cells.withColumn("missing_pct", F.col("missing_cells") * 100.0 / F.col("cells")).drop("_late")
    resets = tables["file_counter_resets"].unionByName(still_open)
    late_resets = _batches(spark, output, "late_resets")
    if late_resets is not None:
        resets = resets.unionByName(late_resets)
    tables["file_counter_resets"] = resets.groupBy("source_file", "head_id").agg(F.sum("counter_resets").alias("counter_resets"))
    return tables


def resets_per_file(log: DataFrame) -> DataFrame:
    """(source_file, head_id, counter_resets) of a log with whole paths."""
    return log.groupBy("source_file", "head_id").agg(F.count(F.lit(1)).alias("counter_resets"))


def folded_report(spark: SparkSession, output: str, still_open: DataFrame, resets: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """The tables that an ingest of all files so far would write."""
    schema = [_batches(spark, output, name) for name in SCHEMA]
    if schema[0] is None:
        nothing = RawArchive(empty_rows(spark), spark.createDataFrame([], "file string, error string"), spark.createDataFrame([], "file string, n_unmatched_columns int, incomplete_heads string"))
        schema = [nothing.errors, nothing.warnings, nothing.bad_timestamps]
    removed = _batches(spark, output, "duplicates_removed")
    if removed is None:
        removed = spark.createDataFrame([], "head_id string, removed long")
    duplicates = removed.groupBy("head_id").agg(F.sum("removed").alias("removed"))
    return quality_report(_folded(spark, output, still_open), *schema, resets, duplicates, events)
