"""Raw wide rows: their order, their sampling interval, and the long form.

A raw table has the columns `source_file`, `block`, `row_id`, `timestamp` and
three columns per head. Files follow each other in path order. Inside a file
the rows follow `block`, then `row_id`; a block is a stretch of a file of
bounded size, such as one scan split, and is the unit of parallel work.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.constants import FALLBACK_INTERVAL_SECONDS, GAP_FACTOR, HEAD_COLUMN, HEAD_FIELDS
from spindle.functions import columns as C
from spindle.plans.distribution import duration_band, exact_quantiles
from spindle.plans.slices import BEFORE_HERE, UP_TO_HERE

BLOCK = ["source_file", "block"]
MEDIANS = ["median_with_boundary", "median_in_file", "median_positive"]


def file_order() -> Column:
    """Paths compare folder by folder, as a sorted directory walk does."""
    return F.split("source_file", "/")


def block_order() -> list[Column]:
    return [file_order(), F.col("block")]


def complete_heads(columns: list[str]) -> list[str]:
    """Heads with all three fields among the column names."""
    fields: dict[str, set[str]] = {}
    for column in columns:
        if found := re.match(HEAD_COLUMN, column):
            fields.setdefault(found[1], set()).add(found[2])
    return sorted(head for head, seen in fields.items() if seen == set(HEAD_FIELDS))


def field(head: str, name: str) -> Column:
    """A field of a head as a number; not-a-number means missing."""
    return C.null_if_nan(F.col(f"{head} {name}").cast("double"))


def present(wide: DataFrame, head: str) -> Column:
    """Whether the file of a row has the head."""
    if "file_heads" not in wide.columns:
        return F.lit(True)
    return F.coalesce(F.array_contains("file_heads", head), F.lit(False))


CELLS = {"count": "Count", "torque_nm": "AppTorque", "status_code": "Status"}


def to_readings_long(wide: DataFrame, *keep: str, cells: tuple[str, ...] = tuple(CELLS)) -> DataFrame:
    """One row per raw row and head, for the heads the file of the row has, with
    the `cells` asked for."""
    heads = complete_heads(wide.columns)
    triplet = lambda h: F.struct(F.lit(h).alias("head_id"), *[field(h, CELLS[c]).alias(c) for c in cells])
    listed = F.array(*[triplet(h) for h in heads])
    if "file_heads" in wide.columns:
        listed = F.filter(listed, lambda t: F.array_contains("file_heads", t["head_id"]))
    rows = wide.select(*BLOCK, "row_id", "timestamp", *keep, F.explode(listed).alias("_r"))
    return rows.select(*BLOCK, "row_id", "timestamp", *keep, "_r.*")


def _clock(wide: DataFrame) -> DataFrame:
    return wide.select(*BLOCK, "row_id", C.micros("timestamp").alias("_at"))


def _in_block() -> Window:
    return Window.partitionBy(*BLOCK).orderBy("row_id")


def block_edges(wide: DataFrame) -> DataFrame:
    """First and last time of every block, and the step from the block before.

    One row per block: a scan of any size has as many as it has splits.
    """
    edges = _clock(wide).groupBy(*BLOCK).agg(
        F.min_by("_at", "row_id").alias("first_at"),
        F.max_by("_at", "row_id").alias("last_at"),
        F.count(F.lit(1)).alias("rows"),
    )
    along = Window.partitionBy().orderBy(*block_order())
    other = lambda neighbour: ~F.coalesce(neighbour == F.col("source_file"), F.lit(False))
    edges = edges.withColumns(
        {
            "seq": F.row_number().over(along),
            "previous_at": F.lag("last_at").over(along),
            "previous_file": F.lag("source_file").over(along),
            "file_first": other(F.lag("source_file").over(along)),
            "file_last": other(F.lead("source_file").over(along)),
        }
    )
    return edges.withColumn("file_seq", F.sum(F.col("file_first").cast("int")).over(along.rowsBetween(*UP_TO_HERE)))


def intervals(wide: DataFrame, edges: DataFrame) -> DataFrame:
    """Median sampling interval per file, in seconds, in three flavours.

    `median_with_boundary` also counts the step from the file before;
    `median_in_file` does not; `median_positive` leaves out steps that do not
    advance the clock.
    """
    step = F.col("_at") - F.lag("_at").over(_in_block())
    inner = _clock(wide).select("source_file", step.alias("step"), F.lit(False).alias("crosses"))
    outer = edges.select(
        "source_file", (F.col("first_at") - F.col("previous_at")).alias("step"), F.col("file_first").alias("crosses")
    )
    in_file = ~F.col("crosses")
    medians = {
        "median_with_boundary": 0.5,
        "median_in_file": (0.5, in_file),
        "median_positive": (0.5, in_file & (F.col("step") > 0)),
    }
    band = duration_band(F.col("step"))
    found = exact_quantiles(inner.unionAll(outer), ["source_file"], "step", medians, band)
    seconds = found.select("source_file", *[(F.col(m) / 1e6).alias(m) for m in MEDIANS])
    return edges.select("source_file").distinct().join(seconds, "source_file", "left")


def with_steps(wide: DataFrame) -> DataFrame:
    """Raw rows with their place and their clock.

    `file_seq` is the position of the file among all files with rows,
    `block_seq` that of the block, `block_rows` its length. `step` is the time in
    seconds since the row before, `step_in_file` is null on the first row of a
    file. The medians are those of the file, and `is_gap` marks a step of more
    than twice the median.
    """
    edges = block_edges(wide)
    context = edges.join(intervals(wide, edges), "source_file").select(
        *BLOCK,
        "file_seq",
        F.col("seq").alias("block_seq"),
        F.col("rows").alias("block_rows"),
        "file_first",
        "file_last",
        "previous_file",
        "previous_at",
        *MEDIANS,
    )
    at = C.micros("timestamp")
    position = F.row_number().over(_in_block())
    step = (at - F.coalesce(F.lag(at).over(_in_block()), "previous_at")) / 1e6
    typical = F.col("median_with_boundary")
    usual = F.when(typical > 0, typical).otherwise(FALLBACK_INTERVAL_SECONDS)
    starts = F.col("file_first") & (F.col("position") == 1)
    return (
        wide.join(context, BLOCK)
        .withColumns({"position": position, "step": step})
        .withColumns(
            {
                "step_in_file": F.when(~starts, F.col("step")),
                "is_gap": F.coalesce(F.col("step") > GAP_FACTOR * usual, F.lit(False)),
            }
        )
        .drop("previous_at")
    )


def count_changes(stepped: DataFrame) -> DataFrame:
    """The readings at which the count of a head changes, in long form.

    A count that repeats the last known one can neither be an increment nor a
    reset. All heads of a raw row are compared in one window over the wide rows,
    and only the rest is unfolded: production makes few changes per row. Kept
    besides changes are the first and last row of each block and a missing value
    right after a zero, so that runs of zeros keep their ends.

    `position` counts the rows of the block, `count_before` is the count one row
    earlier in the block.
    """
    heads = complete_heads(stepped.columns)
    here = _in_block()
    past = here.rowsBetween(*BEFORE_HERE)
    counts = {h: field(h, "Count") for h in heads}
    rows = stepped.withColumns(
        {f"_lag_{h}": F.lag(c).over(here) for h, c in counts.items()}
        | {f"_known_{h}": F.last(c, ignorenulls=True).over(past) for h, c in counts.items()}
    )
    edge = (F.col("position") == 1) | (F.col("position") == F.col("block_rows"))

    def reading(h):
        count, known = counts[h], F.col(f"_known_{h}")
        changed = count.isNotNull() & (known.isNull() | (count != known))
        lost = count.isNull() & (F.col(f"_lag_{h}") == 0)
        values = F.struct(
            F.lit(h).alias("head_id"),
            count.alias("count"),
            field(h, "AppTorque").alias("torque_nm"),
            field(h, "Status").alias("status_code"),
            F.col(f"_lag_{h}").alias("count_before"),
        )
        return F.when(present(stepped, h) & (edge | changed | lost), values)

    each = F.explode(F.array(*[reading(h) for h in heads])).alias("_r")
    keep = [*BLOCK, "row_id", "timestamp", "file_seq", "block_rows", "position", "is_gap"]
    return rows.select(*keep, each).where(F.col("_r").isNotNull()).select(*keep, "_r.*")
