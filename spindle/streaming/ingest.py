"""Incremental ingest: the batch operators over new files plus a small state.

The stream carries file names, not rows: each micro-batch is the list of all new
files. They are put in path order, whatever their modification times, in a stored
table, and read in batches of files, each whole and by its own header. Between
batches the state keeps one row per head and one for the machine. It enters a
batch as a few rows that sort before the new files: the last valid count of every
head, a zero after it if the head was inside an undecided run of zeros, and the
idle run still open.

Every batch writes under its own batch number, reads the state of the batch
before and is committed alone. The numbers follow from the micro-batch and the
place in it, and the list of its batches is stored when it begins. Running a
micro-batch again after a failure passes over the committed batches and replaces
the output of the one that failed.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindle.constants import EVENT_SCHEMA
from spindle.operators import counters, events, idle, readings
from spindle.operators.ingest import base_name, repair
from spindle.plans.ranks import ranked
from spindle.session import configure, cut
from spindle.sources import tables
from spindle.sources.folders import children, put, remove
from spindle.sources.raw_csv import CSV_FILES, RawArchive, read_wide_csv
from spindle.streaming import quality_state

STATE_FILE = ""  # sorts before every path
WAITING = ("head_id", "valid_count", "segments", "open_at", "open_file")
BATCH = "batch"
NUMBERS = 1 << 32  # batch numbers of one micro-batch
COMMITS = "_state/commits"
STAGES = "_stage"
AT_ONCE = 4  # writes of one batch


class State(NamedTuple):
    """What a batch leaves for the next one."""

    heads: DataFrame  # a row per head of the newest file
    machine: DataFrame  # one row
    waiting: DataFrame  # open runs of zeros of heads that the newest file lacks
    pending: DataFrame  # raw rows of open runs by head and file
    last_events: DataFrame  # time of the last event of every head


def ingest_stream(
    spark: SparkSession, path: str, output: str, files_per_batch: int = 100, checkpoint: str | None = None
) -> StreamingQuery:
    """Start ingesting the CSV files below `path`; ends when all files present
    have been read, and can be started again for files that come later.

    The files present are read in path order, in batches of at most
    `files_per_batch`. A later file that sorts before one already read stops the
    query.
    """
    configure(spark)
    names = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", CSV_FILES)
        .load(path)
        .select("path")
    )

    def process(batch: DataFrame, number: int) -> None:
        ingest_files(batch.sparkSession, batch, output, number, files_per_batch)

    return (
        names.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint or f"{output.rstrip('/')}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def ingest_files(spark: SparkSession, files: DataFrame, output: str, number: int, files_per_batch: int) -> None:
    """The batches of one micro-batch, but for those committed before."""
    batches = _listed(spark, files, output, number, files_per_batch)
    done = set(committed(spark, output))
    count = batches.agg(F.coalesce(F.max("part") + 1, F.lit(0))).first()[0]
    for part in range(count):
        if number * NUMBERS + part in done:
            continue
        # at most files_per_batch names
        paths = [row["path"] for row in batches.where(F.col("part") == part).orderBy("position").collect()]
        ingest_batch(spark, paths, output, number * NUMBERS + part)
        put(spark, f"{output.rstrip('/')}/{COMMITS}/{number * NUMBERS + part}")
        remove(spark, f"{output.rstrip('/')}/{STAGES}")


def _listed(spark: SparkSession, files: DataFrame, output: str, number: int, size: int) -> DataFrame:
    """(path, position, part): the files of a micro-batch in path order and the
    batches it was begun with, as a stored table."""
    path = _folder(output, "_state/files", number)
    if "_SUCCESS" not in children(spark, path):
        placed = ranked(files.select("path"), F.split("path", "/"))
        part = F.floor((F.col("position") - 1) / size)
        placed.select("path", "position", part.alias("part")).write.mode("overwrite").parquet(path)
    return spark.read.schema("path string, position long, part long").parquet(path)


def committed(spark: SparkSession, output: str) -> list[int]:
    """The numbers of the batches that are done."""
    return sorted(int(n) for n in children(spark, f"{output.rstrip('/')}/{COMMITS}") if n.isdigit())


def _folder(output: str, name: str, number: int) -> str:
    return f"{output.rstrip('/')}/{name}/{BATCH}={number}"


def _state(spark: SparkSession, output: str, number: int) -> State | None:
    """State left by the newest batch with rows before this one."""
    names = children(spark, f"{output.rstrip('/')}/_state/machine")  # written last
    found = sorted((int(n.partition("=")[2]) for n in names if n.startswith(f"{BATCH}=")), reverse=True)
    whole = (n for n in found if n < number and "_SUCCESS" in children(spark, _folder(output, "_state/machine", n)))
    last = next(whole, None)
    if last is None:
        return None
    return State(*[spark.read.parquet(_folder(output, f"_state/{name}", last)) for name in State._fields])


def ingest_batch(spark: SparkSession, paths: list[str], output: str, number: int) -> None:
    """Ingest the files of one batch."""
    before = _state(spark, output, number)
    if before is not None:
        last = before.machine.first()
        if paths[0].split("/") <= last["last_file"].split("/"):
            raise ValueError(f"{paths[0]} sorts before {last['last_file']}, which was already read")
    write = partial(_write, output=output, number=number)
    read = read_wide_csv(spark, paths)
    archive = RawArchive(_materialise(spark, read.rows, output, f"{STAGES}/rows", number), read.errors, read.warnings)
    quality_state.write_schema(archive, write)
    wide = archive.wide
    if wide.isEmpty():
        return
    context = wide if before is None else wide.unionByName(_state_rows(wide, before), allowMissingColumns=True)
    rows = _materialise(spark, readings.with_steps(context), output, f"{STAGES}/steps", number)
    changes = _materialise(spark, readings.count_changes(rows), output, f"{STAGES}/changes", number)
    settled = _settled(_materialise(spark, repair(changes), output, f"{STAGES}/repaired", number))
    eras = cut(_eras(settled))  # heads x files of the batch
    own = F.col("source_file") != STATE_FILE
    resolved, waiting, masked = _waiting(settled, before, readings.complete_heads(wide.columns))

    def closures() -> DataFrame:
        moved = _with_past_segments(counters.reset_segments(settled), eras, before)
        moved = _materialise(spark, moved, output, f"{STAGES}/moved", number)
        found = events.enrich_status(counters.detect_closures(moved.where(own)))
        kept = _materialise(spark, events.dedupe_events(found), output, f"{STAGES}/kept", number)
        removed = events.duplicates_removed(found)
        again = _repeated(spark, settled.where(own), kept, before, output, number)
        if again is not None:
            kept = kept.join(again, events.COUNTER_KEY, "left_anti")
            removed = removed.union(again.groupBy("head_id").agg(F.count(F.lit(1)).alias("removed")))
        write(removed, f"{quality_state.FOLDER}/duplicates_removed")
        log = _resets(moved, before)
        late = log.where(F.col("_late")).drop("_late")
        log = log.drop("_late")
        if resolved is not None:
            log, late = log.unionByName(resolved), late.unionByName(resolved)
        log.withColumn("source_file", base_name()).write.mode("overwrite").parquet(_folder(output, "counter_resets", number))
        write(quality_state.resets_per_file(late), f"{quality_state.FOLDER}/late_resets")
        timed = _speed(kept, before).withColumn("source_file", base_name())
        timed = timed.select(*EVENT_SCHEMA.fieldNames(), "segment_id")
        timed.write.mode("overwrite").option("compression", "zstd").parquet(_folder(output, tables.CLOSURE_EVENTS, number))
        return spark.read.schema(timed.schema).parquet(_folder(output, tables.CLOSURE_EVENTS, number))

    def idle_runs() -> DataFrame:
        runs = _materialise(spark, _idle_runs(rows, before), output, f"{STAGES}/idle", number)
        newest = rows.agg(F.max("file_seq")).scalar()
        open_run = F.col("touches_end") & (F.col("last_file_seq") == newest)
        idle.long_runs(runs.where(~open_run)).write.mode("overwrite").parquet(_folder(output, tables.IDLE_PERIODS, number))
        return runs.where(open_run)

    def open_zeros() -> None:
        pending = quality_state.open_rows(settled.where(own))
        if before is not None:
            decided = quality_state.fates(settled, masked, STATE_FILE)
            shown, still = quality_state.late_masks(before.pending, decided)
            pending = pending.unionByName(still)
            write(shown, f"{quality_state.FOLDER}/late_masks")
        write(pending, "_state/pending")

    previous = None if before is None else last["data_file"]
    report = quality_state.file_tables(rows.where(own), settled.where(own), previous)
    writes = [partial(write, table, f"{quality_state.FOLDER}/{name}") for name, table in report.items()]
    timed, open_run, *_ = _at_once(spark, [closures, idle_runs, open_zeros, *writes])
    _write_state(wide, settled, eras, timed, open_run, waiting, before, output, number, paths[-1])


def _at_once(spark: SparkSession, steps: list[Callable]) -> list:
    """The results of steps that need nothing of each other. Their jobs share the
    cores, so a stage of few tasks leaves none idle. If one fails, so does the
    batch."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return [step.result() for step in running]


def _write(table: DataFrame, name: str, output: str, number: int) -> None:
    table.write.mode("overwrite").parquet(_folder(output, name, number))


def _repeated(spark: SparkSession, settled: DataFrame, kept: DataFrame, before: State | None, output: str, number: int) -> DataFrame | None:
    """Keys of events that earlier batches have already. Counters only repeat in a
    segment if the head started afresh, so events of other heads are not read."""
    if before is None:
        return None
    files = settled.agg(F.countDistinct("file_seq")).scalar()
    whole = settled.groupBy("head_id").agg(F.countDistinct("file_seq").alias("files")).select("head_id", (F.col("files") == files).alias("whole"))
    current = before.heads.select("head_id", F.lit(True).alias("current"))
    afresh = before.last_events.join(whole, "head_id").join(current, "head_id", "left").where(~F.coalesce(F.col("whole") & F.col("current"), F.lit(False)))
    heads = [row["head_id"] for row in afresh.select("head_id").collect()]  # at most MAX_HEAD_IDS names
    if not heads:
        return None
    key = "head_id string, segment_id long, counter long, batch long"
    earlier = spark.read.schema(key).parquet(f"{output.rstrip('/')}/{tables.CLOSURE_EVENTS}").where((F.col(BATCH) < number) & F.col("head_id").isin(heads))
    return _materialise(spark, kept.select(*events.COUNTER_KEY).join(earlier, events.COUNTER_KEY, "left_semi"), output, f"{STAGES}/repeated", number)


def _materialise(spark: SparkSession, df: DataFrame, output: str, name: str, number: int) -> DataFrame:
    path = _folder(output, name, number)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _state_rows(wide: DataFrame, before: State) -> DataFrame:
    """The state as raw rows of a file before all others: the last valid counts,
    then a row with a zero for heads inside an undecided run."""
    heads, machine = before.heads, before.machine
    known = readings.complete_heads(wide.columns)
    listed = heads.groupBy().agg(
        F.collect_list("head_id").alias("file_heads"),  # at most MAX_HEAD_IDS entries
        *[F.max(F.when(F.col("head_id") == h, F.col("valid_count"))).alias(f"{h} Count") for h in known],
        *[F.bool_or((F.col("head_id") == h) & F.col("is_open")).alias(f"_{h}") for h in known],
    )
    rows = listed.withColumns({"timestamp": machine.select("last_timestamp").scalar()}).withColumn(
        "row_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    )
    second = F.col("row_id") == 1
    counts = {f"{h} Count": F.when(second & F.col(f"_{h}"), 0.0).otherwise(F.col(f"{h} Count")) for h in known}
    nothing = F.lit(None).cast("double")
    empty = {f"{h} {name}": nothing for h in known for name in ("AppTorque", "Status")}
    return (
        rows.withColumns(counts | empty)
        .withColumns({"source_file": F.lit(STATE_FILE), "block": F.lit(0).cast("long")})
        .drop(*[f"_{h}" for h in known])
    )


def _eras(settled: DataFrame) -> DataFrame:
    """(head_id, file_seq, _carried, _latest): a head that a file lacks starts
    afresh in the next one. Whether a file belongs to the unbroken sequence that
    begins with the state, and to the last one of the head."""
    head = Window.partitionBy("head_id")  # a row per file of the batch
    files = settled.select("head_id", "file_seq", (F.col("source_file") == STATE_FILE).alias("_past")).distinct()
    era = F.col("file_seq") - F.row_number().over(head.orderBy("file_seq"))
    files = files.withColumn("_era", era)
    past, last = F.max(F.when(F.col("_past"), F.col("_era"))).over(head), F.max(F.struct("file_seq", "_era")).over(head)["_era"]
    same = lambda other: F.coalesce(F.col("_era") == other, F.lit(False))
    return files.select("head_id", "file_seq", same(past).alias("_carried"), same(last).alias("_latest"))


def _with_past_segments(moved: DataFrame, eras: DataFrame, before) -> DataFrame:
    if before is None:
        return moved
    past = eras.where("_carried").join(before.heads.select("head_id", "segments"), "head_id")
    past = F.broadcast(past.select("head_id", "file_seq", F.col("segments").alias("_past")))  # heads x files of the batch
    total = F.col("segment_id") + F.coalesce("_past", F.lit(0))
    return moved.join(past, ["head_id", "file_seq"], "left").withColumn("segment_id", total).drop("_past")


def _settled(repaired: DataFrame) -> DataFrame:
    """Add `is_open`: the reading belongs to a run of zeros that later files may
    still mask. Only the zeros after the last settled count of a head qualify."""
    order = F.struct("file_seq", "block", "row_id")
    known = F.col("valid_count").isNotNull()
    last = repaired.groupBy("head_id").agg(F.max(F.when(known & ~F.col("undecided"), order)).alias("_settled"))
    last = F.broadcast(cut(last))  # at most MAX_HEAD_IDS rows, found once for all that read the readings
    after = F.col("_settled").isNull() | (order > F.col("_settled"))
    return repaired.join(last, "head_id").withColumn("is_open", F.col("undecided") & after).drop("_settled")


def _resets(moved: DataFrame, before) -> DataFrame:
    """Resets that are certain by now, and whether they began in an earlier batch
    (`_late`): such a one is logged with the time and file at which its zeros
    began."""
    log = counters.counter_resets(moved.where(~F.col("is_open")))
    if before is None:
        return log.withColumn("_late", F.lit(False))
    began = F.broadcast(before.heads.select("head_id", "open_at", "open_file"))  # MAX_HEAD_IDS rows
    late = F.col("source_file") == STATE_FILE
    return (
        log.join(began, "head_id", "left")
        .withColumns(
            {
                "timestamp": F.when(late, F.col("open_at")).otherwise(F.col("timestamp")),
                "source_file": F.when(late, F.col("open_file")).otherwise(F.col("source_file")),
                "_late": late,
            }
        )
        .select(*log.columns, "_late")
    )


def _as_reset(run: DataFrame) -> DataFrame:
    """The reset that an undecided run of zeros turns out to be."""
    return run.select(
        F.col("open_at").alias("timestamp"),
        "head_id",
        F.col("valid_count").alias("previous_count"),
        F.lit(0.0).alias("new_count"),
        F.col("segments").alias("segment_before"),
        (F.col("segments") + 1).alias("segment_after"),
        F.col("open_file").alias("source_file"),
    )


def _waiting(settled: DataFrame, before, heads: list[str]) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """Undecided runs of heads that later files left out. The first count the
    head reports again decides: returns the resets found so, what still waits,
    and whether the zeros of each decided run are masked."""
    if before is None:
        return None, None, None
    counted = (F.col("count") != 0) & (F.col("source_file") != STATE_FILE)
    order = F.struct("file_seq", "block", "row_id")
    first = settled.groupBy("head_id").agg(F.min_by("count", F.when(counted, order)).alias("_first"))
    absent = before.heads.where(F.col("is_open") & ~F.col("head_id").isin(*heads))
    runs = before.waiting.select(*WAITING).unionByName(absent.select(*WAITING)).join(first, "head_id", "left")
    resets = _as_reset(runs.where(F.col("_first") < F.col("valid_count")))
    decided = runs.where(F.col("_first").isNotNull()).select("head_id", (F.col("_first") >= F.col("valid_count")).alias("masked"))
    return resets, runs.where(F.col("_first").isNull()).drop("_first"), decided


def _speed(found: DataFrame, before) -> DataFrame:
    if before is None:
        return events.derive_speed(found)
    past = before.last_events.select("head_id", F.col("last_event").alias("timestamp"), F.lit(STATE_FILE).alias("source_file"))
    both = found.unionByName(past, allowMissingColumns=True)
    return events.derive_speed(both).where(F.col("source_file") != STATE_FILE)


def _idle_runs(rows: DataFrame, before) -> DataFrame:
    runs = idle.idle_runs_per_file(rows)
    if before is None:
        return idle.merge_runs_across_files(runs)
    # the open run takes the place of the state's file, the first one
    one = F.lit(1).cast("long")
    past = before.machine.where(F.col("idle_start").isNotNull()).select(
        one.alias("file_seq"),
        one.alias("last_file_seq"),
        F.col("idle_start").alias("start_at"),
        F.col("idle_end").alias("end_at"),
        F.col("idle_rows").alias("n_rows"),
        F.lit(False).alias("touches_start"),
        F.lit(True).alias("touches_end"),
        F.struct(F.lit(-1).alias("block_seq"), F.lit(-1).alias("_run")).cast(runs.schema["_order"].dataType).alias("_order"),
    )
    return idle.merge_runs_across_files(runs.unionByName(past))


def _write_state(wide, settled, eras, timed, open_run, waiting, before, output, number, last_file) -> None:
    order = F.struct("file_seq", "block", "row_id")
    known = F.col("valid_count").isNotNull()
    newest = settled.agg(F.max("file_seq")).scalar()
    first_open = F.min(F.when(F.col("is_open"), F.struct(order, "timestamp", "source_file", "previous_valid")))
    per_head = settled.join(F.broadcast(eras), ["head_id", "file_seq"]).groupBy("head_id").agg(
        F.max_by("valid_count", F.when(known & ~F.col("is_open"), order)).alias("_valid"),
        first_open.alias("_open"),
        # the reset of an open run is not certain, so it is not counted yet
        F.count(F.when((F.col("counter_delta") < 0) & ~F.col("is_open") & F.col("_latest"), 1)).alias("_resets"),
        F.bool_or(F.col("_carried") & F.col("_latest")).alias("_goes_on"),
        F.max("file_seq").alias("_seq"),
    )
    heads = per_head
    if before is not None:
        past = before.heads.select("head_id", "segments", "open_at", "open_file")
    else:
        past = heads.select("head_id").limit(0).select(
            "head_id",
            F.lit(0).cast("long").alias("segments"),
            F.lit(None).cast("timestamp_ntz").alias("open_at"),
            F.lit(None).cast("string").alias("open_file"),
        )
    is_open = F.col("_open").isNotNull()
    carried = F.col("_open.source_file") == STATE_FILE
    table = heads.join(past, "head_id", "left").select(
        "head_id",
        F.col("_valid").alias("valid_count"),
        is_open.alias("is_open"),
        F.when(is_open & carried, F.col("open_at")).when(is_open, F.col("_open.timestamp")).alias("open_at"),
        F.when(is_open & carried, F.col("open_file"))
        .when(is_open, F.col("_open.source_file"))
        .alias("open_file"),
        (F.when(F.col("_goes_on"), F.coalesce("segments", F.lit(0))).otherwise(0) + F.col("_resets")).alias("segments"),
        (F.col("_seq") == newest).alias("_current"),
    )
    table = _materialise(wide.sparkSession, table, output, f"{STAGES}/heads", number)
    # a head missing from the newest file starts afresh, as in the batch ingest
    table.where("_current").drop("_current").write.mode("overwrite").parquet(_folder(output, "_state/heads", number))
    left = table.where(~F.col("_current") & F.col("is_open")).select(*WAITING)
    if waiting is not None:
        left = left.unionByName(waiting.select(*WAITING))
    left.write.mode("overwrite").parquet(_folder(output, "_state/waiting", number))
    last_events = timed.groupBy("head_id").agg(F.max("timestamp").alias("last_event"))
    if before is not None:
        last_events = last_events.unionByName(before.last_events).groupBy("head_id").agg(F.max("last_event").alias("last_event"))
    _write(last_events, "_state/last_events", output, number)
    last_row = F.struct(readings.file_order(), "block", "row_id")
    pending = open_run.agg(
        F.max("start_at").alias("idle_start"), F.max("end_at").alias("idle_end"), F.max("n_rows").alias("idle_rows")
    )
    newest_row = wide.agg(F.max_by("timestamp", last_row).alias("last_timestamp"), F.max_by("source_file", last_row).alias("data_file"))
    machine = newest_row.select(
        "last_timestamp", "data_file", F.lit(last_file).alias("last_file"), pending.select(F.struct("*")).scalar().alias("_p")
    )
    machine.select("last_timestamp", "data_file", "last_file", "_p.*").write.mode("overwrite").parquet(
        _folder(output, "_state/machine", number)
    )


def finish_idle(spark: SparkSession, output: str) -> DataFrame:
    """All idle periods so far, with the run still open at the end of the data."""
    closed = spark.read.parquet(f"{output.rstrip('/')}/{tables.IDLE_PERIODS}").drop(BATCH)
    open_run = _state(spark, output, 1 << 62).machine.where(F.col("idle_start").isNotNull()).select(
        F.col("idle_start").alias("start_at"), F.col("idle_end").alias("end_at"), F.col("idle_rows").alias("n_rows")
    )
    return closed.unionByName(idle.long_runs(open_run))


def _still_open(spark: SparkSession, output: str) -> DataFrame:
    """Resets for which the runs of zeros still open are taken."""
    newest = _state(spark, output, 1 << 62)
    return _as_reset(newest.heads.where("is_open").select(*WAITING).unionByName(newest.waiting.select(*WAITING)))


def finish_resets(spark: SparkSession, output: str) -> DataFrame:
    """All resets so far, counting runs of zeros still open as resets."""
    log = spark.read.parquet(f"{output.rstrip('/')}/counter_resets").drop(BATCH)
    return log.unionByName(_still_open(spark, output).withColumn("source_file", base_name()))


RESETS = "timestamp timestamp_ntz, head_id string, previous_count double, new_count double, segment_before long, segment_after long, source_file string"


def finish_quality(spark: SparkSession, output: str) -> dict[str, DataFrame]:
    """The quality report over all files so far: the tables, by name, that a
    batch ingest of them writes."""
    if _state(spark, output, 1 << 62) is None:  # no file had a row
        log, still, found = spark.createDataFrame([], RESETS), spark.createDataFrame([], RESETS), spark.createDataFrame([], EVENT_SCHEMA)
    else:
        log, still, found = finish_resets(spark, output), _still_open(spark, output), stream_events(spark, output)
    return quality_state.folded_report(spark, output, quality_state.resets_per_file(still), log, found)


def write_quality(spark: SparkSession, output: str) -> str:
    """Store the report beside the events, as an ingest does."""
    return tables.write_quality_tables(finish_quality(spark, output), output)


def stream_events(spark: SparkSession, output: str) -> DataFrame:
    """The event table written so far."""
    path = f"{output.rstrip('/')}/{tables.CLOSURE_EVENTS}"
    if not children(spark, path):
        return spark.createDataFrame([], EVENT_SCHEMA)
    return spark.read.schema(EVENT_SCHEMA).parquet(path).drop(BATCH)


def ingest_statistics(spark: SparkSession, output: str) -> DataFrame:
    """Running breakdowns as a streaming aggregation over the event table."""
    rows = (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("recursiveFileLookup", "true")
        .parquet(f"{output.rstrip('/')}/{tables.CLOSURE_EVENTS}")
    )
    return rows.groupBy("head_id", "data_quality", "classification").agg(
        F.count(F.lit(1)).alias("events"), F.sum("inferred_closure_count").alias("inferred_closures")
    )
