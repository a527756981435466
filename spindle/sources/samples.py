"""Telemetry-shaped views over the sample tables.

The sample `events` table is a stream of user actions. These views give it the
shape of machine telemetry: a user is a capping head, an action is a reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.constants import EVENT_COLUMNS
from spindle.operators.events import derive_speed, enrich_status
from spindle.operators.idle import idle_periods
from spindle.operators.ingest import repair
from spindle.operators.readings import count_changes, to_readings_long, with_steps
from spindle.session import configure
from spindle.sources.tables import stored

HEADS = 36
RAW_HEADS = ("H01", "H02", "H03")
ROWS_PER_BLOCK = 4096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def _mapped_status():
    kind, i = F.col("event_type"), F.col("event_id")
    error = F.when(i % 3 == 0, 9).when(i % 3 == 1, 65).otherwise(4)
    return (
        F.when(i % 211 == 13, F.lit(None).cast("int"))
        .when(kind == "signup", 2)
        .when(kind == "error", error)
        .otherwise(0)
    )


def _day_file():
    return F.concat(F.lit("day_"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".csv"))


def event_block(spark: SparkSession, folder: str) -> DataFrame:
    """Increments before enrichment, one per sample event."""
    i = F.col("event_id")
    number = (F.col("user_id") % HEADS + 1).cast("int")
    delta = F.when(i % 7 == 0, 3).otherwise(1).cast("long")
    return table(spark, folder, "events").select(
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("H"), F.lpad(number.cast("string"), 2, "0")).alias("head_id"),
        F.lit(0).cast("long").alias("segment_id"),
        (i + 1).alias("counter"),
        delta.alias("counter_delta"),
        delta.alias("inferred_closure_count"),
        F.when(i % 97 == 0, "gap").when(delta > 1, "aggregated").otherwise("single").alias("data_quality"),
        F.col("value").alias("torque_nm"),
        _mapped_status().alias("status_code"),
        _day_file().alias("source_file"),
    )


def enriched_events(spark: SparkSession, folder: str) -> DataFrame:
    """Closure events without the columns that need the previous event."""
    return enrich_status(event_block(spark, folder))


def closure_events(spark: SparkSession, folder: str) -> DataFrame:
    build = lambda: derive_speed(enriched_events(spark, folder)).select(*EVENT_COLUMNS)
    return stored(spark, folder, "closure_events", build)


def stepped(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows with their steps, staged as in an ingest."""
    return stored(spark, folder, "raw_rows", lambda: with_steps(raw_wide(spark, folder)))


def idle_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "idle_periods", lambda: idle_periods(stepped(spark, folder)))


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """All raw readings in long form, with the gap flag of their row."""
    return to_readings_long(stepped(spark, folder), "file_seq", "is_gap")


def repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Count changes with masked counts and deltas."""
    changes = stored(spark, folder, "count_changes", lambda: count_changes(stepped(spark, folder)))
    return stored(spark, folder, "repaired_changes", lambda: repair(changes))


def raw_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Raw per-row telemetry of three heads, with the faults real exports have:
    zeroed and missing counts, counter restarts, zero rows at the end of a day,
    negative torque and unknown status codes."""
    i = F.col("event_id")
    since_reset = i % 4000
    night = (F.hour("ts") == 23) & (F.minute("ts") >= 30)
    idle = (i % 1000).between(300, 359)
    stuck = {"H01": (i % 500).between(100, 109), "H02": (i % 500).between(100, 109), "H03": (i % 500).between(200, 449)}
    lost = {"H01": (i % 2000) == 1610, "H02": (i % 701) == 0, "H03": F.lit(False)}
    count = {"H01": since_reset, "H02": F.floor(since_reset / 2), "H03": F.floor(since_reset / 3) * 2}
    columns = []
    for k, head in enumerate(RAW_HEADS):
        own = F.col("user_id") % len(RAW_HEADS) == k
        nothing = F.lit(None).cast("double")
        counted = F.when(stuck[head], 0.0).when(lost[head], nothing).otherwise(count[head].cast("double"))
        torque = (
            F.when(i % 997 == 3, nothing)
            .when((i % 1003 == 5) & own, -F.col("value"))
            .when(own, F.col("value"))
            .otherwise(0.0)
        )
        status = F.when(idle, 2).when((i % 1201 == 9) & own, 77).when(own, _mapped_status()).otherwise(0)
        columns += [
            F.when(night, 0.0).otherwise(counted).alias(f"{head} Count"),
            F.when(night, 0.0).otherwise(torque).alias(f"{head} AppTorque"),
            F.when(night, 0.0).otherwise(status.cast("double")).alias(f"{head} Status"),
        ]
    return table(spark, folder, "events").select(
        _day_file().alias("source_file"),
        F.floor(i / ROWS_PER_BLOCK).cast("int").alias("block"),
        i.alias("row_id"),
        F.col("ts").alias("timestamp"),
        *columns,
    )
