"""Raw exports: wide CSV files, each read by its own header."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.constants import HEAD_COLUMN, HEAD_FIELDS, TIMESTAMP
from spindle.operators.readings import complete_heads
from spindle.plans.ranks import ranked
from spindle.session import configure, cut

# executors get these functions by value and need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CSV_FILES = "*.csv"
HEADER_CHUNK = 65_536


def _listing(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # without the content column the files themselves are not opened
    return reader.load(path).select("path", "length")


def discover_raw_files(spark: SparkSession, path: str) -> DataFrame:
    """The given file, or every CSV file below the folder: (path, length,
    position), where position follows the sorted paths, which is the order of
    time. Fails when there is none."""
    try:
        found = _listing(configure(spark), path, CSV_FILES)
        if found.isEmpty():
            name = path.rstrip("/").rsplit("/", 1)[-1]
            found = _listing(spark, path, None).where(F.element_at(F.split("path", "/"), -1) == name)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        found = None
    if found is None or found.isEmpty():
        raise FileNotFoundError(f"no CSV files found under {path}")
    return ranked(found, F.split("path", "/")).select("path", "length", "position")


def header_lines(files: DataFrame, most: int | None = None) -> DataFrame:
    """(path, header): the first line of each file. Every task reads the
    beginning of its own files and nothing else of them. `most`: how many files
    there are at most, where that is known."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = files.select("path").repartition(min(n, most or n), "path")
    return spread.mapInPandas(_first_lines, "path string, header string")


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(header=batch["path"].map(_first_line))


def _first_line(path: str) -> str | None:
    from pyarrow import fs

    if path.startswith("file:"):
        system, name = fs.LocalFileSystem(), unquote("/" + path[len("file:") :].lstrip("/"))
    else:
        system, name = fs.FileSystem.from_uri(path)
    line = b""
    with system.open_input_stream(name) as stream:
        while b"\n" not in line and (more := stream.read(HEADER_CHUNK)):
            line += more
    return line.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8-sig", "replace")


def header_columns(headers: DataFrame) -> DataFrame:
    """One row per column of each file: (path, position, column, head_id,
    field); head and field only where the name follows the pattern."""
    names = F.posexplode(F.split("header", ",")).alias("position", "column")
    columns = headers.select("path", names).withColumn("column", F.regexp_replace("column", '^"|"$', ""))
    part = lambda i: F.nullif(F.regexp_extract("column", HEAD_COLUMN, i), F.lit(""))
    return columns.withColumns({"head_id": part(1), "field": part(2)})


def validate_schema(headers: DataFrame) -> DataFrame:
    """One row per file: `accepted`, the `error` that rejects it, its complete
    heads, and what only deserves a warning: `unmatched_columns` and
    `incomplete_heads`."""
    columns = header_columns(headers)
    per_head = columns.where(F.col("head_id").isNotNull()).groupBy("path", "head_id").agg(
        (F.size(F.collect_set("field")) == len(HEAD_FIELDS)).alias("complete")
    )
    heads = per_head.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(F.col("complete"), F.col("head_id")))).alias("heads"),
        F.array_sort(F.collect_list(F.when(~F.col("complete"), F.col("head_id")))).alias("incomplete_heads"),
    )
    is_time = F.col("column") == TIMESTAMP
    others = F.when(F.col("head_id").isNull() & ~is_time, F.struct("position", "column"))
    files = columns.groupBy("path").agg(
        F.bool_or(is_time).alias("_timed"),
        F.transform(F.array_sort(F.collect_list(others)), lambda c: c["column"]).alias("unmatched_columns"),
    )
    none = F.array().cast("array<string>")
    checked = files.join(heads, "path", "left").withColumns(
        {"heads": F.coalesce("heads", none), "incomplete_heads": F.coalesce("incomplete_heads", none)}
    )
    error = F.when(~F.col("_timed"), f"missing required '{TIMESTAMP}' column").when(
        F.size("heads") == 0, "no complete Count/AppTorque/Status triplet found"
    )
    return checked.withColumn("error", error).withColumn("accepted", F.col("error").isNull()).drop("_timed")


def schema_errors(checked: DataFrame) -> DataFrame:
    return checked.where(~F.col("accepted")).select(_base_name().alias("file"), "error")


def schema_warnings(checked: DataFrame) -> DataFrame:
    odd = (F.size("unmatched_columns") > 0) | (F.size("incomplete_heads") > 0)
    return checked.where(odd).select(
        _base_name().alias("file"),
        F.size("unmatched_columns").alias("n_unmatched_columns"),
        F.array_join("incomplete_heads", ",").alias("incomplete_heads"),
    )


def _base_name():
    return F.element_at(F.split("path", "/"), -1)


def parse_timestamps(rows: DataFrame, column: str = TIMESTAMP) -> DataFrame:
    """ISO 8601 text to naive timestamps; unreadable text becomes null."""
    return rows.withColumn(column, F.col(column).try_cast("timestamp_ntz"))


@dataclass
class RawArchive:
    """The accepted files of a folder as one raw table, and what was noticed."""

    rows: DataFrame  # raw table with `file_heads`; unreadable timestamps are null
    errors: DataFrame
    warnings: DataFrame

    @property
    def wide(self) -> DataFrame:
        """The rows with a timestamp."""
        return self.rows.where(F.col(TIMESTAMP).isNotNull())

    @property
    def bad_timestamps(self) -> DataFrame:
        bad = F.count(F.when(F.col(TIMESTAMP).isNull(), 1)).alias("bad_timestamps")
        return self.rows.groupBy("source_file").agg(bad).where(F.col("bad_timestamps") > 0)


def read_wide_csv(spark: SparkSession, path: str | list[str]) -> RawArchive:
    """Read a folder, a file or a list of files.

    Spark binds the columns of all files in one CSV scan by the position they
    have in a single header, so files are read in groups with the same header.
    A scan split is one block; it is as long as `spark.sql.files.maxPartitionBytes`.
    """
    if isinstance(path, str):
        files, most = discover_raw_files(spark, path), None
    else:
        files, most = configure(spark).createDataFrame([(p,) for p in path], "path string"), len(path)
    headers = cut(header_lines(files, most))  # a row per file; each file is opened once
    checked = cut(validate_schema(headers))
    groups = (
        headers.join(checked.where("accepted").select("path"), "path")
        .groupBy("header")
        .agg(F.array_sort(F.collect_list("path")).alias("paths"))
        .collect()  # names of files, grouped by header
    )
    if groups:
        parts = [_read_group(spark, g["header"], g["paths"]) for g in groups]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    else:
        rows = empty_rows(spark)
    return RawArchive(rows, schema_errors(checked), schema_warnings(checked))


def empty_rows(spark: SparkSession) -> DataFrame:
    """The rows of an archive without an accepted file; one head, so that the
    columns of heads have types."""
    fields = "".join(f", `H01 {field}` double" for field in HEAD_FIELDS)
    schema = f"source_file string, block long, row_id long, {TIMESTAMP} timestamp_ntz, file_heads array<string>{fields}"
    return spark.createDataFrame([], schema)


def _read_group(spark: SparkSession, header: str, paths: list[str]) -> DataFrame:
    names = [n.strip('"') for n in header.split(",")]
    heads = complete_heads(names)
    seen: Counter = Counter()
    fields = []
    for name in names:  # the first of several columns with one name counts
        fields.append(T.StructField(f"{name}.{seen[name]}" if seen[name] else name, T.StringType()))
        seen[name] += 1
    scan = (
        spark.read.schema(T.StructType(fields))
        .option("header", "true")
        .csv(paths)
        .withColumns(
            {
                "source_file": F.col("_metadata.file_path"),
                "block": F.col("_metadata.file_block_start"),
                "row_id": F.monotonically_increasing_id(),
            }
        )
    )
    wanted = [f"{h} {field}" for field in HEAD_FIELDS for h in heads]
    numbers = [F.col(f"`{c}`").try_cast("double").alias(c) for c in wanted]
    rows = scan.select("source_file", "block", "row_id", TIMESTAMP, *numbers)
    return parse_timestamps(rows).withColumn("file_heads", F.array(*[F.lit(h) for h in heads]))
