"""Data quality of the raw files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.constants import FALLBACK_INTERVAL_SECONDS, GAP_FACTOR, STATUS
from spindle.functions import columns as C
from spindle.operators.readings import BLOCK, CELLS, complete_heads, field, present, to_readings_long
from spindle.plans.slices import BEFORE_HERE

PART = ["head_id", *BLOCK]
OUTLIER_SIGMAS = 3


def trailing_zero_rows(wide: DataFrame) -> DataFrame:
    """Per file, the length of its closing stretch of rows where every field of
    every head is zero. They are counted, never removed."""
    zero = lambda h, name: F.coalesce(field(h, name) == 0, F.lit(False))
    all_zero = F.lit(True)
    for h in complete_heads(wide.columns):
        all_zero = all_zero & (~present(wide, h) | (zero(h, "Count") & zero(h, "AppTorque") & zero(h, "Status")))
    # rows with steps know their place in the block and need no sort
    place = F.col("position") if "position" in wide.columns else F.row_number().over(Window.partitionBy(*BLOCK).orderBy("row_id"))
    rows = wide.select(*BLOCK, all_zero.alias("_z"), place.alias("_rn"))
    blocks = rows.groupBy(*BLOCK).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(F.when(~F.col("_z"), F.col("_rn"))).alias("_last_other")
    )
    # a block counts if every later block of the file is all zero
    later = Window.partitionBy("source_file").orderBy(F.desc("block")).rowsBetween(*BEFORE_HERE)
    reached = F.max("_last_other").over(later).isNull()
    length = F.when(reached, F.col("_rows") - F.coalesce("_last_other", F.lit(0))).otherwise(0)
    return (
        blocks.withColumn("_zeros", length)
        .groupBy("source_file")
        .agg(F.sum("_zeros").alias("trailing_zero_rows"))
    )


def file_times(stepped: DataFrame) -> DataFrame:
    """Per file: rows, span and median sampling interval."""
    at, order = C.micros("timestamp"), F.struct("block", "row_id")
    per_file = stepped.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min_by(at, order).alias("_first"),
        F.max_by(at, order).alias("_last"),
        F.max("median_in_file").alias("median_interval_s"),
    )
    return per_file.select(
        "source_file",
        "rows",
        C.from_micros("_first").alias("first_timestamp"),
        C.from_micros("_last").alias("last_timestamp"),
        ((F.col("_last") - F.col("_first")) / 1e6).alias("duration_seconds"),
        "median_interval_s",
    )


def sampling_gaps(stepped: DataFrame) -> DataFrame:
    """Steps inside a file of more than twice its median interval."""
    typical, step = F.col("median_in_file"), F.col("step_in_file")
    ends = C.micros("timestamp")
    return stepped.where((typical > 0) & (step > GAP_FACTOR * typical)).select(
        "source_file",
        step.alias("gap_seconds"),
        C.from_micros(ends - F.round(step * 1e6).cast("long")).alias("starts_after"),
        F.col("timestamp").alias("ends_at"),
    )


def boundary_gaps(stepped: DataFrame) -> DataFrame:
    """Pauses between the last row of a file and the first of the next."""
    step = F.col("step")
    typical = F.coalesce(F.nullif("median_in_file", F.lit(0.0)), F.lit(FALLBACK_INTERVAL_SECONDS))
    starts = stepped.where(F.col("step_in_file").isNull() & (step > GAP_FACTOR * typical))
    return starts.select(
        F.col("previous_file").alias("prev_file"),
        F.col("source_file").alias("next_file"),
        C.from_micros(C.micros("timestamp") - F.round(step * 1e6).cast("long")).alias("prev_end"),
        F.col("timestamp").alias("next_start"),
        step.alias("gap_seconds"),
    )


def missing_cells(wide: DataFrame, repaired: DataFrame) -> DataFrame:
    """Empty cells per file once corrupted counts are masked. Cells are counted
    in the wide rows, which are not unfolded."""
    heads = {h: present(wide, h) for h in complete_heads(wide.columns)}
    empty = [F.when(here & field(h, name).isNull(), 1).otherwise(0) for h, here in heads.items() for name in CELLS.values()]
    per_file = wide.groupBy("source_file").agg(
        F.sum(_added(empty)).alias("_empty"),
        (F.sum(_added([here.cast("int") for here in heads.values()])) * len(CELLS)).alias("cells"),
        _added([F.max(here).cast("long") for here in heads.values()]).alias("n_heads"),
    )
    cells = per_file.where(F.col("n_heads") > 0)
    hidden = masked_rows(repaired)
    return cells.join(hidden, "source_file", "left").select(
        "source_file",
        (F.col("_empty") + F.coalesce("masked_counts", F.lit(0))).alias("missing_cells"),
        "cells",
        F.coalesce("masked_counts", F.lit(0)).alias("masked_counts"),
        "n_heads",
        ((F.col("_empty") + F.coalesce("masked_counts", F.lit(0))) * 100.0 / F.col("cells")).alias("missing_pct"),
    )


def _added(terms: list[Column]) -> Column:
    """The sum of any number of columns, as a tree of small depth."""
    if not terms:
        return F.lit(0)
    middle = len(terms) // 2
    return _added(terms[:middle]) + _added(terms[middle:]) if middle else terms[0]


def masked_rows(repaired: DataFrame) -> DataFrame:
    """Counts masked per file."""
    return zero_rows(repaired, F.col("masked"), "source_file").withColumnRenamed("n", "masked_counts")


def zero_rows(repaired: DataFrame, wanted: Column, *keys: str) -> DataFrame:
    """Raw rows (`n`) for which the kept zeros of a kind stand: each one stands
    for the rows up to the next kept reading of its block."""
    here = Window.partitionBy(*PART).orderBy("row_id")
    until = F.coalesce(F.lead("position").over(here), F.col("block_rows") + 1)
    runs = repaired.withColumn("_length", until - F.col("position"))
    return runs.where(wanted).groupBy(*keys).agg(F.sum("_length").alias("n"))


def _steps(repaired: DataFrame) -> DataFrame:
    """Change of the valid count since the row before in the file; null where
    either is missing."""
    here = Window.partitionBy(*PART).orderBy("row_id")
    edge = repaired.groupBy(*PART).agg(F.max_by(F.struct("valid_count"), "row_id").alias("_edge"))
    along = Window.partitionBy("head_id", "source_file").orderBy("block")
    carry = edge.select(*PART, F.lag("_edge").over(along)["valid_count"].alias("_edge"))
    hidden = (F.col("count_before") == 0) & F.lag("masked").over(here)
    before = F.when(F.col("position") == 1, F.col("_edge")).when(~F.coalesce(hidden, F.lit(False)), F.col("count_before"))
    return repaired.join(carry, PART).withColumn("_step", F.col("valid_count") - before)


def invalid_torque(wide: DataFrame, repaired: DataFrame) -> DataFrame:
    """Per file and head: negative torque, zero torque on an increment, and
    readings more than three deviations from the mean."""
    key = ["source_file", "head_id"]
    torque = {h: F.when(present(wide, h), field(h, "AppTorque")) for h in complete_heads(wide.columns)}
    # one row per block with the moments of all its heads: a large file does not
    # become one join group. The rows stay wide: they are not unfolded.
    moments = lambda x: F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    per_file = wide.groupBy("source_file").agg(*[moments(x).alias(f"_m_{h}") for h, x in torque.items()])
    per_block = wide.select(*BLOCK).distinct().join(per_file, "source_file")

    def faults(h, x):
        known = F.col(f"_m_{h}")
        far = (known["sd"] > 0) & (F.abs(x - known["mean"]) > OUTLIER_SIGMAS * known["sd"])
        return F.struct(
            F.lit(h).alias("head_id"), C.count_if(x < 0).alias("negative"), C.count_if(far).alias("outliers_gt_3sigma"), F.max(present(wide, h)).alias("_here")
        )

    found = wide.join(per_block, BLOCK).groupBy("source_file").agg(F.array(*[faults(h, x) for h, x in torque.items()]).alias("_f"))
    counted = found.select("source_file", F.inline("_f")).where("_here").drop("_here")
    x = F.col("torque_nm")
    idle = _steps(repaired).where((x == 0) & (F.col("_step") > 0))
    zeros = idle.groupBy(*key).agg(F.count(F.lit(1)).alias("zero_on_increment"))
    return counted.join(zeros, key, "left").na.fill(0, ["zero_on_increment"])


def in_file_resets(repaired: DataFrame) -> DataFrame:
    """Per file and head, drops of the count seen inside the file alone."""
    return _steps(repaired).groupBy("source_file", "head_id").agg(
        C.count_if(F.col("_step") < 0).alias("in_file_resets")
    )


def file_counter_resets(repaired: DataFrame) -> DataFrame:
    """Per file and head, resets found with the context of all files."""
    return repaired.groupBy("source_file", "head_id").agg(
        C.count_if(F.col("counter_delta") < 0).alias("counter_resets")
    )


def status_distribution(wide: DataFrame) -> DataFrame:
    known = to_readings_long(wide, cells=("status_code",)).where(F.col("status_code").isNotNull())
    code = F.col("status_code").cast("int").alias("status_code")
    return known.groupBy("source_file", "head_id", code).agg(F.count(F.lit(1)).alias("n"))


def unexpected_status(wide: DataFrame) -> DataFrame:
    """Codes the status table does not list."""
    return unexpected(status_distribution(wide))


def unexpected(distribution: DataFrame) -> DataFrame:
    return distribution.where(~F.col("status_code").isin(*STATUS))


def report_tables(stepped: DataFrame, repaired: DataFrame) -> dict[str, DataFrame]:
    """The tables of the report with rows per file, from the raw rows with steps
    and the count changes with `masked` and `counter_delta`."""
    return {
        "file_quality": file_times(stepped),
        "missing_cells": missing_cells(stepped, repaired),
        "trailing_zero_rows": trailing_zero_rows(stepped),
        "sampling_gaps": sampling_gaps(stepped),
        "boundary_gaps": boundary_gaps(stepped),
        "invalid_torque": invalid_torque(stepped, repaired),
        "status_distribution": status_distribution(stepped),
        "file_counter_resets": file_counter_resets(repaired),
    }


def totals_of(tables: dict[str, DataFrame]) -> DataFrame:
    """The report for all files together, one row, from the tables per file."""
    one = lambda table: table.select(F.struct("*")).scalar()
    files = tables["file_quality"].agg(
        F.count(F.lit(1)).alias("files_processed"),
        F.sum("rows").alias("total_rows"),
        F.min("first_timestamp").alias("first_timestamp"),
        F.max("last_timestamp").alias("last_timestamp"),
    )
    empty = tables["missing_cells"].agg(
        F.sum("missing_cells").alias("missing_cells_total"),
        (F.sum("missing_cells") * 100.0 / F.sum("cells")).alias("missing_pct_overall"),
        F.sum("masked_counts").alias("corrupted_rows_masked_total"),
    )
    torque = tables["invalid_torque"].agg(
        F.sum("negative").alias("negative_torque_total"), F.sum("outliers_gt_3sigma").alias("torque_outliers_total")
    )
    resets = tables["file_counter_resets"].agg(F.sum("counter_resets").alias("counter_resets_total"))
    odd = unexpected(tables["status_distribution"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unexpected_status_total"))
    zeros = tables["trailing_zero_rows"].agg(F.sum("trailing_zero_rows").alias("trailing_zero_rows_total"))
    gaps = tables["sampling_gaps"].agg(
        F.count(F.lit(1)).alias("n_gaps"), F.countDistinct("source_file").alias("files_with_gaps")
    )
    edges = tables["boundary_gaps"].agg(F.count(F.lit(1)).alias("boundary_gaps"))
    parts = [files, empty, torque, resets, odd, zeros, gaps, edges]
    names = [f"_{i}" for i in range(len(parts))]
    row = tables["file_quality"].sparkSession.range(1).select(*[one(p).alias(n) for p, n in zip(parts, names)])
    return row.select(*[f"{n}.*" for n in names])


def quality_totals(stepped: DataFrame, repaired: DataFrame) -> DataFrame:
    return totals_of(report_tables(stepped, repaired))


def status_totals(wide: DataFrame) -> DataFrame:
    return status_distribution(wide).groupBy("status_code").agg(F.sum("n").alias("n"))


def resets_per_head(repaired: DataFrame) -> DataFrame:
    return file_counter_resets(repaired).groupBy("head_id").agg(F.sum("counter_resets").alias("counter_resets"))


def ingest_breakdowns(events: DataFrame) -> DataFrame:
    """Events and inferred closures per head, per quality tag and per outcome,
    in one pass."""
    n, pieces = F.count(F.lit(1)), F.sum("inferred_closure_count")
    dims = ["head_id", "data_quality", "classification"]
    sets = events.groupingSets([["head_id"], ["data_quality"], ["classification"]], *dims)
    table = sets.agg(n.alias("events"), pieces.alias("inferred_closures"))
    name = F.when(F.col("head_id").isNotNull(), "head").when(F.col("data_quality").isNotNull(), "data_quality")
    return table.select(
        name.otherwise("classification").alias("breakdown"),
        F.coalesce(*dims).alias("value"),
        "events",
        "inferred_closures",
    )


def ingestion_shares(events: DataFrame) -> DataFrame:
    """Percent of the events per outcome and per quality tag."""
    table = ingest_breakdowns(events).where(F.col("breakdown") != "head")
    whole = Window.partitionBy("breakdown")  # a handful of outcomes and tags
    share = F.col("events") * 100.0 / F.sum("events").over(whole)
    return table.select("breakdown", "value", "events", share.alias("pct"))


def idle_summary(idle: DataFrame) -> DataFrame:
    """Number and hours of idle periods, and the longest one."""
    longest = F.struct(F.col("duration_seconds"), -C.micros("start_time"))
    return idle.agg(
        F.count(F.lit(1)).alias("idle_periods"),
        (F.sum("duration_seconds") / 3600.0).alias("total_idle_hours"),
        (F.max("duration_seconds") / 3600.0).alias("longest_hours"),
        F.max_by("start_time", longest).alias("longest_start"),
        F.max_by("end_time", longest).alias("longest_end"),
    )
