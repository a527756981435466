"""Registered queries: sources, sinks, cleaning, reconstruction, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindle.catalog.oracle_views import CLOCK, HEADS, IDLE, LONG, RAW, REPAIRED, TELE, label, outcome, rejected
from spindle.catalog.registry import register
from spindle.constants import STATUS
from spindle.operators import counters, heads, idle, ingest, quality, readings, summary
from spindle.session import workspace
from spindle.sources import raw_csv, samples, tables
from spindle.streaming import ingest as streaming

CELLS = [f"{h} {f}" for f in ("Count", "AppTorque", "Status") for h in samples.RAW_HEADS]
DAY_OF = r"day=(\d{4}-\d{2}-\d{2})"
DAY_SQL = "substr(source_file, 5, 10)"


def csv_files(spark, folder, columns=CELLS, root=None):
    """The raw sample rows as CSV, one file per day."""
    path = root or workspace(spark, "raw_csv")
    rows = samples.raw_wide(spark, folder).select(
        F.to_date("timestamp").alias("day"), "row_id", "timestamp", *columns
    )
    (
        rows.repartitionByRange("day")
        .sortWithinPartitions("day", "row_id")
        .drop("row_id")
        .write.partitionBy("day")
        .option("header", "true")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .csv(path)
    )
    return path


def day_of(column="path"):
    return F.regexp_extract(column, DAY_OF, 1)


def raw(spark, folder):
    return samples.raw_wide(spark, folder)


def repaired(spark, folder):
    return samples.repaired(spark, folder)


# --- sources -------------------------------------------------------------------------

register(
    "discover_raw_files",
    lambda s, d: raw_csv.discover_raw_files(s, csv_files(s, d)).select(
        day_of().alias("day"), F.col("position").cast("bigint").alias("position"), (F.col("length") > 0).alias("has_data")
    ),
    RAW,
    f"""SELECT {DAY_SQL} AS day, row_number() OVER (ORDER BY source_file) AS position, true AS has_data
        FROM (SELECT DISTINCT source_file FROM raw)""",
)


def _mixed_archive(spark, folder):
    """Two exports below one folder, of all heads and of a part of the columns."""
    root = workspace(spark, "mixed")
    days = samples.raw_wide(spark, folder).select(
        F.to_date("timestamp").alias("day"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "row_id", *CELLS
    )
    odd = F.dayofmonth("day") % 2 == 1
    swapped = ["H02 Count", "H01 Count", "H01 AppTorque", "H02 AppTorque", "H02 Status", "H01 Status", "H03 Count"]
    for name, part, columns in (("full", odd, CELLS), ("part", ~odd, swapped)):
        rows = days.where(part).repartitionByRange("day").sortWithinPartitions("day", "row_id")
        rows.select("day", "timestamp", *columns).write.partitionBy("day").option("header", "true").csv(f"{root}/{name}")
    return root


register(
    "read_wide_csv",
    lambda s, d: raw_csv.read_wide_csv(s, _mixed_archive(s, d)).wide.select(
        day_of("source_file").alias("day"),
        "timestamp",
        F.array_join("file_heads", ",").alias("heads"),
        *[F.col(c).alias(c.replace(" ", "_").lower()) for c in CELLS],
    ),
    RAW + ", cut AS (SELECT *, day(\"timestamp\") % 2 = 1 AS whole FROM raw)",
    f"""SELECT {DAY_SQL} AS day, "timestamp", CASE WHEN whole THEN 'H01,H02,H03' ELSE 'H01,H02' END AS heads,
      c1 AS h01_count, c2 AS h02_count, CASE WHEN whole THEN c3 END AS h03_count,
      t1 AS h01_apptorque, t2 AS h02_apptorque, CASE WHEN whole THEN t3 END AS h03_apptorque,
      s1 AS h01_status, s2 AS h02_status, CASE WHEN whole THEN s3 END AS h03_status FROM cut""",
    " ".join(c.replace(" ", "_").lower() for c in CELLS),
)
register(
    "validate_schema",
    lambda s, d: raw_csv.validate_schema(
        raw_csv.header_lines(raw_csv.discover_raw_files(s, _mixed_archive(s, d)))
    ).select(
        day_of().alias("day"),
        "accepted",
        "error",
        F.array_join("heads", ",").alias("heads"),
        F.array_join("incomplete_heads", ",").alias("incomplete_heads"),
        F.array_join("unmatched_columns", ",").alias("unmatched_columns"),
    ),
    RAW,
    f"""SELECT DISTINCT {DAY_SQL} AS day, true AS accepted, CAST(NULL AS VARCHAR) AS error,
          CASE WHEN day("timestamp") % 2 = 1 THEN 'H01,H02,H03' ELSE 'H01,H02' END AS heads,
          CASE WHEN day("timestamp") % 2 = 1 THEN '' ELSE 'H03' END AS incomplete_heads, '' AS unmatched_columns FROM raw""",
)
register(
    "parse_timestamps",
    lambda s, d: raw_csv.parse_timestamps(
        samples.table(s, d, "events").select(
            "event_id",
            F.when(F.col("event_id") % 50 == 7, "not a time")
            .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
            .alias("timestamp"),
        )
    ),
    "",
    'SELECT event_id, CASE WHEN event_id % 50 <> 7 THEN ts END AS "timestamp" FROM events',
)
register(
    "to_readings_long",
    lambda s, d: readings.to_readings_long(raw(s, d)).drop("block"),
    RAW + "," + LONG,
    "SELECT * FROM long",
    "count torque_nm status_code",
)

# --- sinks and stored tables ------------------------------------------------------------

_EVENT_COLUMNS = (
    '"timestamp", head_id, head_number, counter, counter_delta, inferred_closure_count, data_quality, torque_nm,'
    " status_code, status_label, is_reject, is_successful, classification, source_file, time_since_last_closure,"
    " capping_speed_pph"
)


def _stored_events(spark, folder):
    out = workspace(spark, "tables")
    tables.write_closure_events(samples.closure_events(spark, folder), out)
    return tables.load_closure_events(spark, out).drop(tables.EVENT_DATE)


def _old_events(spark, folder):
    """A table from before the count of inferred closures got its name."""
    out = workspace(spark, "old_tables")
    old = samples.closure_events(spark, folder).withColumnRenamed("inferred_closure_count", "accepted_closure_count")
    old.write.parquet(out)
    return tables.load_closure_events(spark, out)


for name, run in {"write_closure_events": _stored_events, "load_closure_events": _old_events}.items():
    register(
        name,
        run,
        TELE,
        f"SELECT {_EVENT_COLUMNS} FROM tele",
        "torque_nm time_since_last_closure capping_speed_pph",
    )


def _stored_idle(spark, folder):
    out = workspace(spark, "tables")
    tables.write_idle_periods(samples.idle_intervals(spark, folder), out)
    return tables.load_idle_periods(spark, out)


for name in ("write_idle_periods", "load_idle_periods"):
    register(name, _stored_idle, IDLE, "SELECT * FROM idle", "duration_seconds")

_SHARE_OF_ZEROS = """SELECT source_file, sum(CASE WHEN row_id > coalesce(last_other, -1) THEN 1 ELSE 0 END)::BIGINT AS trailing_zero_rows
  FROM (SELECT *, max(CASE WHEN NOT coalesce(c1 = 0 AND t1 = 0 AND s1 = 0 AND c2 = 0 AND t2 = 0 AND s2 = 0
      AND c3 = 0 AND t3 = 0 AND s3 = 0, false) THEN row_id END) OVER (PARTITION BY source_file) AS last_other FROM raw)
  GROUP BY source_file"""


def _stored_quality(spark, folder):
    out = workspace(spark, "tables")
    tables.write_quality_tables({"trailing_zero_rows": quality.trailing_zero_rows(raw(spark, folder))}, out)
    return tables.load_quality_report(spark, out, "trailing_zero_rows").select("source_file", "trailing_zero_rows")


for name in ("write_quality_tables", "load_quality_report"):
    register(name, _stored_quality, RAW, _SHARE_OF_ZEROS)


def _stored_analytics(spark, folder):
    out = workspace(spark, "tables")
    table = heads.head_comparison(samples.closure_events(spark, folder))
    tables.write_analytics_tables({"head_comparison": table}, out)
    return spark.read.schema(table.schema).json(f"{out}/analytics/head_comparison")


register(
    "write_analytics_tables",
    _stored_analytics,
    HEADS,
    "SELECT * FROM ranked",
    "mean_torque_nm std_torque_nm success_rate_pct",
)

# --- cleaning and quality ------------------------------------------------------------------

register("trailing_zero_rows", lambda s, d: quality.trailing_zero_rows(raw(s, d)), RAW, _SHARE_OF_ZEROS)
register(
    "mask_corrupted_counts",
    lambda s, d: counters.mask_corrupted_counts(samples.readings(s, d)).select(
        "source_file", "row_id", "head_id", "count", "masked", "valid_count"
    ),
    REPAIRED,
    "SELECT source_file, row_id, head_id, count, masked, valid_count FROM repaired",
    "count valid_count",
)
register(
    "first_nonzero_after",
    lambda s, d: counters.block_context(
        counters.block_summary(samples.readings(s, d).withColumn("block", F.lit(0)))
    )
    .where("at_file_end")
    .select("head_id", "source_file", F.col("close_after").alias("first_nonzero_after")),
    RAW
    + ","
    + LONG
    + """, looked AS (SELECT *, lead(row_id) OVER (PARTITION BY head_id, source_file ORDER BY row_id) IS NULL AS file_last,
      first_value(nullif(count, 0) IGNORE NULLS) OVER (PARTITION BY head_id ORDER BY row_id
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM long)""",
    "SELECT head_id, source_file, later AS first_nonzero_after FROM looked WHERE file_last",
    "first_nonzero_after",
)
register(
    "sampling_gaps",
    lambda s, d: quality.sampling_gaps(samples.stepped(s, d)),
    CLOCK,
    """SELECT source_file, step_in_file AS gap_seconds,
         make_timestamp(epoch_us("timestamp") - CAST(round(step_in_file * 1e6) AS BIGINT)) AS starts_after, "timestamp" AS ends_at
       FROM clock WHERE in_file > 0 AND step_in_file > 2 * in_file""",
    "gap_seconds",
)
register(
    "file_times",
    lambda s, d: quality.file_times(samples.stepped(s, d)),
    CLOCK,
    """SELECT source_file, count(*) AS rows, min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp,
         (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6 AS duration_seconds, any_value(in_file) AS median_interval_s
       FROM clock GROUP BY source_file""",
    "duration_seconds median_interval_s",
)
register(
    "boundary_gaps",
    lambda s, d: quality.boundary_gaps(samples.stepped(s, d)),
    CLOCK,
    """SELECT prev_file, source_file AS next_file, prev_end, "timestamp" AS next_start, step AS gap_seconds FROM
       (SELECT *, lag(source_file) OVER (ORDER BY row_id) AS prev_file, lag("timestamp") OVER (ORDER BY row_id) AS prev_end FROM clock)
       WHERE step_in_file IS NULL AND step > 2 * coalesce(nullif(in_file, 0), 1.0)""",
    "gap_seconds",
)
register(
    "missing_cells",
    lambda s, d: quality.missing_cells(raw(s, d), repaired(s, d)),
    REPAIRED,
    """SELECT *, missing_cells * 100.0 / cells AS missing_pct FROM
       (SELECT source_file, CAST(sum((valid_count IS NULL)::INT + (torque_nm IS NULL)::INT + (status_code IS NULL)::INT) AS BIGINT) AS missing_cells,
         count(*) * 3 AS cells, count(*) FILTER (WHERE masked) AS masked_counts, count(DISTINCT head_id) AS n_heads
        FROM repaired GROUP BY source_file)""",
    "missing_pct",
)
_TORQUE_FAULTS = """SELECT source_file, head_id, count(*) FILTER (WHERE torque_nm < 0) AS negative,
      count(*) FILTER (WHERE torque_nm = 0 AND step_count > 0) AS zero_on_increment,
      count(*) FILTER (WHERE sd > 0 AND abs(torque_nm - m) > 3 * sd) AS outliers_gt_3sigma
    FROM (SELECT *, avg(torque_nm) OVER w AS m, stddev_samp(torque_nm) OVER w AS sd FROM repaired
      WINDOW w AS (PARTITION BY source_file, head_id)) GROUP BY source_file, head_id"""
register("invalid_torque", lambda s, d: quality.invalid_torque(raw(s, d), repaired(s, d)), REPAIRED, _TORQUE_FAULTS)
_CODES = "SELECT source_file, head_id, CAST(status_code AS INTEGER) AS status_code, count(*) AS n FROM long WHERE status_code IS NOT NULL GROUP BY ALL"
register("status_distribution", lambda s, d: quality.status_distribution(raw(s, d)), RAW + "," + LONG, _CODES)
_KNOWN = ", ".join(map(str, STATUS))
register(
    "unexpected_status",
    lambda s, d: quality.unexpected_status(raw(s, d)),
    RAW + "," + LONG,
    f"SELECT * FROM ({_CODES}) WHERE status_code NOT IN ({_KNOWN})",
)
register(
    "status_totals",
    lambda s, d: quality.status_totals(raw(s, d)),
    RAW + "," + LONG,
    "SELECT CAST(status_code AS INTEGER) AS status_code, count(*) AS n FROM long WHERE status_code IS NOT NULL GROUP BY 1",
)
register(
    "in_file_resets",
    lambda s, d: quality.in_file_resets(repaired(s, d)),
    REPAIRED,
    "SELECT source_file, head_id, count(*) FILTER (WHERE step_count < 0) AS in_file_resets FROM repaired GROUP BY 1, 2",
)
register(
    "file_counter_resets",
    lambda s, d: quality.file_counter_resets(repaired(s, d)),
    REPAIRED,
    "SELECT source_file, head_id, count(*) FILTER (WHERE counter_delta < 0) AS counter_resets FROM repaired GROUP BY 1, 2",
)
register(
    "resets_per_head",
    lambda s, d: quality.resets_per_head(repaired(s, d)),
    REPAIRED,
    "SELECT head_id, count(*) FILTER (WHERE counter_delta < 0) AS counter_resets FROM repaired GROUP BY 1",
)


def _totals(spark, folder):
    return quality.quality_totals(samples.stepped(spark, folder), repaired(spark, folder))


_TOTALS = f"""SELECT (SELECT count(DISTINCT source_file) FROM raw) AS files_processed, (SELECT count(*) FROM raw) AS total_rows,
      (SELECT min("timestamp") FROM raw) AS first_timestamp, (SELECT max("timestamp") FROM raw) AS last_timestamp,
      missing_cells_total, missing_cells_total * 100.0 / cells AS missing_pct_overall, corrupted_rows_masked_total,
      negative_torque_total, torque_outliers_total, counter_resets_total, unexpected_status_total,
      (SELECT CAST(sum(trailing_zero_rows) AS BIGINT) FROM ({_SHARE_OF_ZEROS})) AS trailing_zero_rows_total,
      (SELECT count(*) FROM clock WHERE in_file > 0 AND step_in_file > 2 * in_file) AS n_gaps,
      (SELECT count(DISTINCT source_file) FROM clock WHERE in_file > 0 AND step_in_file > 2 * in_file) AS files_with_gaps,
      (SELECT count(*) FROM clock WHERE step_in_file IS NULL AND step > 2 * coalesce(nullif(in_file, 0), 1.0)) AS boundary_gaps
    FROM (SELECT CAST(sum((valid_count IS NULL)::INT + (torque_nm IS NULL)::INT + (status_code IS NULL)::INT) AS BIGINT) AS missing_cells_total,
        count(*) * 3 AS cells, count(*) FILTER (WHERE masked) AS corrupted_rows_masked_total,
        count(*) FILTER (WHERE counter_delta < 0) AS counter_resets_total,
        count(*) FILTER (WHERE status_code NOT IN ({_KNOWN})) AS unexpected_status_total FROM repaired)
      CROSS JOIN (SELECT CAST(sum(negative) AS BIGINT) AS negative_torque_total,
        CAST(sum(outliers_gt_3sigma) AS BIGINT) AS torque_outliers_total FROM ({_TORQUE_FAULTS}))"""
register("quality_totals", _totals, REPAIRED, _TOTALS, "missing_pct_overall")
register(
    "quality_flags",
    lambda s, d: summary.quality_flags(_totals(s, d)),
    REPAIRED + f", totals AS ({_TOTALS})",
    """SELECT flag, n FROM (SELECT 'unexpected_status_codes' AS flag, unexpected_status_total AS n FROM totals
       UNION ALL SELECT 'boundary_gaps', boundary_gaps FROM totals
       UNION ALL SELECT 'counter_resets', counter_resets_total FROM totals) WHERE n > 0""",
)
register(
    "ingest_breakdowns",
    lambda s, d: quality.ingest_breakdowns(samples.closure_events(s, d)),
    TELE,
    """SELECT 'head' AS breakdown, head_id AS value, count(*) AS events, CAST(sum(inferred_closure_count) AS BIGINT) AS inferred_closures
         FROM tele GROUP BY head_id
       UNION ALL SELECT 'data_quality', data_quality, count(*), CAST(sum(inferred_closure_count) AS BIGINT) FROM tele GROUP BY data_quality
       UNION ALL SELECT 'classification', classification, count(*), CAST(sum(inferred_closure_count) AS BIGINT) FROM tele GROUP BY classification""",
)
register(
    "ingestion_shares",
    lambda s, d: quality.ingestion_shares(samples.closure_events(s, d)),
    TELE,
    """SELECT 'data_quality' AS breakdown, data_quality AS value, count(*) AS events, count(*) * 100.0 / (SELECT count(*) FROM tele) AS pct
         FROM tele GROUP BY data_quality
       UNION ALL SELECT 'classification', classification, count(*), count(*) * 100.0 / (SELECT count(*) FROM tele) FROM tele GROUP BY classification""",
    "pct",
)

# --- event reconstruction ---------------------------------------------------------------------

register(
    "counter_deltas",
    lambda s, d: counters.counter_deltas(counters.mask_corrupted_counts(samples.readings(s, d))).select(
        "row_id", "head_id", "previous_valid", "counter_delta"
    ),
    REPAIRED,
    "SELECT row_id, head_id, previous_valid, counter_delta FROM repaired",
    "previous_valid counter_delta",
)
register(
    "flag_gap_rows",
    lambda s, d: readings.with_steps(raw(s, d)).select("row_id", "step", "is_gap"),
    CLOCK,
    "SELECT row_id, step, is_gap FROM clock",
    "step",
)
register(
    "reset_segments",
    lambda s, d: counters.reset_segments(repaired(s, d)).select("row_id", "head_id", "counter_delta", "segment_id"),
    REPAIRED,
    "SELECT row_id, head_id, counter_delta, segment_id FROM repaired WHERE counter_delta <> 0",
    "counter_delta",
)
register(
    "counter_resets",
    lambda s, d: counters.counter_resets(counters.reset_segments(repaired(s, d))),
    REPAIRED,
    """SELECT "timestamp", head_id, previous_valid AS previous_count, valid_count AS new_count, segment_id - 1 AS segment_before,
         segment_id AS segment_after, source_file FROM repaired WHERE counter_delta < 0""",
    "previous_count new_count",
)
_CLOSURES = """SELECT "timestamp", head_id, segment_id, CAST(valid_count AS BIGINT) AS counter, CAST(counter_delta AS BIGINT) AS counter_delta,
      CAST(counter_delta AS BIGINT) AS inferred_closure_count,
      CASE WHEN is_gap THEN 'gap' WHEN counter_delta > 1 THEN 'aggregated' ELSE 'single' END AS data_quality,
      torque_nm, CAST(status_code AS INTEGER) AS status_code, source_file FROM repaired WHERE counter_delta > 0"""
register("detect_closures", lambda s, d: counters.detect_closures(counters.reset_segments(repaired(s, d))), REPAIRED, _CLOSURES, "torque_nm")

# --- idle intervals -------------------------------------------------------------------------------

register(
    "all_heads_idle",
    lambda s, d: raw(s, d).select("row_id", idle.all_heads_idle(raw(s, d)).alias("idle")),
    IDLE,
    "SELECT row_id, idle FROM idle_rows",
)
register(
    "idle_runs_per_file",
    lambda s, d: idle.idle_runs_table(idle.idle_runs_per_file(samples.stepped(s, d))).drop("file_seq"),
    IDLE,
    """SELECT make_timestamp(min(us)) AS start_time, make_timestamp(max(us)) AS end_time, count(*) AS n_rows,
         bool_or(file_first) AS touches_start, bool_or(file_last) AS touches_end, (max(us) - min(us)) / 1e6 AS duration_seconds
       FROM idle_numbered WHERE idle GROUP BY source_file, file_run""",
    "duration_seconds",
)
register(
    "merge_runs_across_files",
    lambda s, d: idle.idle_runs_table(idle.merge_runs_across_files(idle.idle_runs_per_file(samples.stepped(s, d)))).select(
        "start_time", "end_time", "n_rows", "duration_seconds"
    ),
    IDLE,
    "SELECT start_time, end_time, n_rows, duration_seconds FROM idle_merged",
    "duration_seconds",
)
register("idle_periods", lambda s, d: idle.idle_periods(samples.stepped(s, d)), IDLE, "SELECT * FROM idle", "duration_seconds")

# --- whole ingests ----------------------------------------------------------------------------------

# the CSV files hold microseconds and one file per day, so an ingest of them
# must find what the tables say
_INGESTED = REPAIRED + f""", found AS ({_CLOSURES}),
speeds AS (SELECT *, (epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (PARTITION BY head_id ORDER BY "timestamp")) / 1e6 AS time_since_last_closure FROM found),
ingested AS (SELECT "timestamp", head_id, counter, counter_delta, inferred_closure_count, data_quality, torque_nm, status_code,
    {label('status_code')} AS status_label, {rejected('status_code')} AS is_reject, coalesce(status_code = 0, false) AS is_successful,
    {outcome('status_code')} AS classification, time_since_last_closure,
    CASE WHEN time_since_last_closure > 0 THEN 3600.0 * inferred_closure_count / time_since_last_closure END AS capping_speed_pph
  FROM speeds)"""
_INGESTED_DOUBLES = "torque_nm time_since_last_closure capping_speed_pph"


def _batch(spark, folder):
    done = ingest.ingest(spark, csv_files(spark, folder), workspace(spark, "ingested"))
    return done.closure_events.drop("source_file", "head_number", tables.EVENT_DATE)


def _stream(spark, folder, files_per_batch=16):
    """The tables of one streaming ingest, shared by the queries on them. Half of
    the files lack columns and are rejected."""

    def run(out):
        root = workspace(spark, "stream_csv")
        csv_files(spark, folder, root=f"{root}/days")
        csv_files(spark, folder, ["H01 Count", "H02 Status"], f"{root}/parts")
        streaming.ingest_stream(spark, root, out, files_per_batch).awaitTermination()

    return tables.once(spark, folder, "streamed", run)


register("ingest", _batch, _INGESTED, "SELECT * FROM ingested", _INGESTED_DOUBLES)
register(
    "ingest_stream",
    lambda s, d: streaming.stream_events(s, _stream(s, d)).drop("source_file", "head_number"),
    _INGESTED,
    "SELECT * FROM ingested",
    _INGESTED_DOUBLES,
)
register(
    "stream_resets",
    lambda s, d: streaming.finish_resets(s, _stream(s, d)).drop("source_file"),
    REPAIRED,
    """SELECT "timestamp", head_id, previous_valid AS previous_count, valid_count AS new_count, segment_id - 1 AS segment_before,
         segment_id AS segment_after FROM repaired WHERE counter_delta < 0""",
    "previous_count new_count",
)
register(
    "stream_idle",
    lambda s, d: streaming.finish_idle(s, _stream(s, d)),
    IDLE,
    "SELECT * FROM idle",
    "duration_seconds",
)


def _statistics(spark, folder):
    """Run the streaming aggregation to its end and read its sink."""
    counts = streaming.ingest_statistics(spark, _stream(spark, folder))
    name = "stream_statistics_" + workspace(spark, "x").rsplit("-", 1)[1]
    query = (
        counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
        .option("checkpointLocation", workspace(spark, "statistics")).start()
    )
    query.awaitTermination()
    return spark.table(name)


register(
    "stream_ingest_stats",
    _statistics,
    _INGESTED,
    """SELECT head_id, data_quality, classification, count(*) AS events, CAST(sum(inferred_closure_count) AS BIGINT) AS inferred_closures
       FROM ingested GROUP BY 1, 2, 3""",
)


def _stream_report(name):
    return lambda spark, folder: streaming.finish_quality(spark, _stream(spark, folder))[name]


_REMOVED = "SELECT head_id, segment_id, counter, count(*) - 1 AS extra FROM found GROUP BY ALL"
register(
    "stream_quality_totals",
    _stream_report("quality_totals"),
    REPAIRED + f", found AS ({_CLOSURES}), removed AS ({_REMOVED})",
    f"""SELECT *, (SELECT CAST(sum(extra) AS BIGINT) FROM removed) AS duplicate_events_removed_total,
         (SELECT count(DISTINCT source_file) FROM raw) AS schema_errors FROM ({_TOTALS})""",
    "missing_pct_overall",
)
register(
    "stream_schema_errors",
    lambda s, d: _stream_report("schema_errors")(s, d).groupBy("error").agg(F.count(F.lit(1)).alias("files")),
    RAW,
    """SELECT 'no complete Count/AppTorque/Status triplet found' AS error, count(DISTINCT source_file) AS files FROM raw""",
)
register(
    "stream_duplicates_removed",
    _stream_report("duplicates_removed"),
    REPAIRED + f", found AS ({_CLOSURES}), removed AS ({_REMOVED})",
    "SELECT head_id, CAST(sum(extra) AS BIGINT) AS removed FROM removed GROUP BY head_id HAVING sum(extra) > 0",
)
register(
    "stream_breakdowns",
    _stream_report("breakdowns"),
    _INGESTED,
    """SELECT 'head' AS breakdown, head_id AS value, count(*) AS events, CAST(sum(inferred_closure_count) AS BIGINT) AS inferred_closures FROM ingested GROUP BY head_id
       UNION ALL SELECT 'data_quality', data_quality, count(*), CAST(sum(inferred_closure_count) AS BIGINT) FROM ingested GROUP BY data_quality
       UNION ALL SELECT 'classification', classification, count(*), CAST(sum(inferred_closure_count) AS BIGINT) FROM ingested GROUP BY classification""",
)
