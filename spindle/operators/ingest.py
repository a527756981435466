"""The batch ingest: raw files to closure events, idle periods and quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.operators import counters, events, idle, quality, readings, rollup, sketches
from spindle.session import workspace
from spindle.sources import tables
from spindle.sources.raw_csv import read_wide_csv


@dataclass
class IngestResult:
    closure_events: DataFrame
    idle_periods: DataFrame
    quality: dict[str, DataFrame]


def base_name(path: str = "source_file"):
    return F.element_at(F.split(path, "/"), -1)


def repair(changes: DataFrame) -> DataFrame:
    """Count changes with masked counts and deltas."""
    return counters.counter_deltas(counters.mask_corrupted_counts(changes))


def closure_events(repaired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The event table and, per head, how many duplicates it leaves out."""
    found = events.enrich_status(counters.detect_closures(counters.reset_segments(repaired)))
    kept = events.derive_speed(events.dedupe_events(found))
    return kept.withColumn("source_file", base_name()), events.duplicates_removed(found)


def ingest(spark: SparkSession, path: str, output: str) -> IngestResult:
    """Read every CSV file below `path` and write the tables to `output`.

    The raw rows and the repaired count changes feed the events and the quality
    report. They are staged in the shared workspace, not derived again for each.
    """
    archive = read_wide_csv(spark, path)
    staged = lambda name, df: _stage(spark, name, df)
    # reads the CSV files several times: for block edges, steps and rows
    rows = staged("raw_rows", readings.with_steps(archive.wide))
    # masking looks at the changes twice: once per block, once per reading
    repaired = staged("repaired_changes", repair(staged("count_changes", readings.count_changes(rows))))

    found, duplicates = closure_events(repaired)
    tables.write_closure_events(found, output)
    tables.write_idle_periods(idle.idle_periods(rows), output)
    stored = tables.load_closure_events(spark, output)
    tables.write_hourly_cells(rollup.hourly_cells(stored, tables.load_idle_periods(spark, output)), output)
    tables.write_torque_sketches(sketches.daily_sketches(stored), output)

    per_file = {n: staged(n, t) for n, t in quality.report_tables(rows, repaired).items()}  # small; totals and sinks read them
    report = quality_report(
        per_file,
        archive.errors,
        archive.warnings,
        archive.bad_timestamps,
        counters.counter_resets(counters.reset_segments(repaired)).withColumn("source_file", base_name()),
        duplicates,
        stored,
    )
    tables.write_quality_tables(report, output)
    return IngestResult(stored, tables.load_idle_periods(spark, output), report)


def quality_report(per_file, errors, warnings, bad_timestamps, resets, duplicates, events) -> dict[str, DataFrame]:
    """All tables of the report, from those per file with whole paths and what
    else was found."""
    named = lambda df: df.withColumn("source_file", base_name())
    one = lambda df: df.select(F.struct("*")).scalar()
    totals = quality.totals_of(per_file)
    removed = duplicates.agg(F.coalesce(F.sum("removed"), F.lit(0)).alias("duplicate_events_removed_total"))
    rejected = errors.agg(F.count(F.lit(1)).alias("schema_errors"))
    return {
        "quality_totals": totals.withColumns({"_d": one(removed), "_e": one(rejected)})
        .select(*totals.columns, "_d.*", "_e.*"),
        "schema_errors": errors,
        "schema_warnings": warnings,
        "bad_timestamps": named(bad_timestamps),
        **{name: named(table) for name, table in per_file.items() if name != "boundary_gaps"},
        "boundary_gaps": per_file["boundary_gaps"].withColumns(
            {"prev_file": base_name("prev_file"), "next_file": base_name("next_file")}
        ),
        "unexpected_status": named(quality.unexpected(per_file["status_distribution"])),
        "counter_resets": resets,
        "duplicates_removed": duplicates,
        "breakdowns": quality.ingest_breakdowns(events),
    }


def _stage(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    path = workspace(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # no rows leave no schema behind
