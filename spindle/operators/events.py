"""From reconstructed increments to the closure event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions import columns as C
from spindle.plans.slices import previous_axis, sliced


def enrich_status(events: DataFrame) -> DataFrame:
    """Head number, status label and the outcome columns."""
    return events.withColumns(
        {
            "head_number": F.substring("head_id", 2, 2).cast("int"),
            "status_code": F.col("status_code").cast("int"),
            "status_label": C.status_label("status_code"),
            "is_reject": C.is_reject("status_code"),
            "is_successful": C.is_successful("status_code"),
            "classification": C.classification("status_code"),
        }
    )


COUNTER_KEY = ["head_id", "segment_id", "counter"]


def dedupe_events(events: DataFrame) -> DataFrame:
    """The earliest event of every (head, reset segment, counter value).

    An aggregation instead of a ranked window: any number of copies of one
    event collapses before the shuffle.
    """
    rest = [c for c in events.columns if c not in COUNTER_KEY]
    first = F.min_by(F.struct(*rest), F.struct("timestamp", "source_file")).alias("_first")
    kept = events.groupBy(*COUNTER_KEY).agg(first)
    return kept.select(*COUNTER_KEY, "_first.*").select(*events.columns)


def duplicates_removed(events: DataFrame) -> DataFrame:
    """Per head, how many events `dedupe_events` drops; only heads with some."""
    copies = events.groupBy(*COUNTER_KEY).agg((F.count(F.lit(1)) - 1).alias("_extra"))
    return (
        copies.groupBy("head_id").agg(F.sum("_extra").alias("removed")).where(F.col("removed") > 0)
    )


def derive_speed(events: DataFrame) -> DataFrame:
    """Seconds since the previous event of the head, and pieces per hour. Events
    of one time come in the order of their files and counters."""
    timed = events.withColumn("_at", C.micros("timestamp"))
    timed = previous_axis(sliced(timed, "_at"), ["head_id"], "_at", "_previous", ("source_file", "counter"))
    seconds = (F.col("_at") - F.col("_previous")) / F.lit(1_000_000.0)
    pieces = F.col("inferred_closure_count") * F.lit(3600.0)
    return (
        timed.withColumn("time_since_last_closure", seconds)
        .withColumn(
            "capping_speed_pph",
            F.when(F.col("time_since_last_closure") > 0, pieces / F.col("time_since_last_closure")),
        )
        .drop("_at", "_previous", "_slice")
    )
