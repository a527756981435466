"""The telemetry views of `spindle.sources.samples`, in plain SQL."""

from spindle.constants import REJECT_CODES, STATUS

_REJECTS = ", ".join(map(str, REJECT_CODES))
_DAY_FILE = "'day_' || strftime(ts, '%Y-%m-%d') || '.csv'"
_MAPPED = """CASE WHEN event_id % 211 = 13 THEN NULL WHEN event_type = 'signup' THEN 2
  WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 9 WHEN 1 THEN 65 ELSE 4 END ELSE 0 END"""


def label(code: str) -> str:
    cases = " ".join(f"WHEN {c} THEN '{text}'" for c, (text, _) in STATUS.items())
    return f"CASE {code} {cases} ELSE 'Unknown' END"


def rejected(code: str) -> str:
    return f"coalesce({code} IN ({_REJECTS}), false)"


def outcome(code: str) -> str:
    return (
        f"CASE WHEN {code} = 0 THEN 'successful' WHEN {code} IN ({_REJECTS}) THEN 'failed'"
        f" WHEN {code} = 2 THEN 'no_load' ELSE 'other' END"
    )


TELE = f"""
block AS (
  SELECT ts AS "timestamp", 'H' || lpad(CAST(user_id % 36 + 1 AS VARCHAR), 2, '0') AS head_id,
    CAST(0 AS BIGINT) AS segment_id, event_id + 1 AS counter,
    CAST(CASE WHEN event_id % 7 = 0 THEN 3 ELSE 1 END AS BIGINT) AS counter_delta,
    CAST(CASE WHEN event_id % 7 = 0 THEN 3 ELSE 1 END AS BIGINT) AS inferred_closure_count,
    CASE WHEN event_id % 97 = 0 THEN 'gap' WHEN event_id % 7 = 0 THEN 'aggregated' ELSE 'single' END AS data_quality,
    value AS torque_nm, {_MAPPED} AS status_code, {_DAY_FILE} AS source_file
  FROM events),
enriched AS (
  SELECT *, CAST(substr(head_id, 2, 2) AS INTEGER) AS head_number, {label('status_code')} AS status_label,
    {rejected('status_code')} AS is_reject, coalesce(status_code = 0, false) AS is_successful,
    {outcome('status_code')} AS classification
  FROM block),
stepped AS (
  SELECT *, (epoch_us("timestamp") - lag(epoch_us("timestamp"))
    OVER (PARTITION BY head_id ORDER BY "timestamp", counter)) / 1e6 AS time_since_last_closure
  FROM enriched),
tele AS (
  SELECT *, CASE WHEN time_since_last_closure > 0
    THEN 3600.0 * inferred_closure_count / time_since_last_closure END AS capping_speed_pph
  FROM stepped),
real AS (SELECT * FROM tele WHERE status_code <> 2),
good AS (SELECT * FROM tele WHERE status_code = 0),
bad AS (SELECT * FROM real WHERE is_reject)"""


def _head(k: int, stuck: str, lost: str, count: str) -> str:
    own = f"user_id % 3 = {k - 1}"
    night = "(hour(ts) = 23 AND minute(ts) >= 30)"
    return f"""
    CASE WHEN {night} OR {stuck} THEN 0 WHEN {lost} THEN NULL ELSE CAST({count} AS DOUBLE) END AS c{k},
    CASE WHEN {night} THEN 0 WHEN event_id % 997 = 3 THEN NULL WHEN event_id % 1003 = 5 AND {own} THEN -value
      WHEN {own} THEN value ELSE 0 END AS t{k},
    CAST(CASE WHEN {night} THEN 0 WHEN event_id % 1000 BETWEEN 300 AND 359 THEN 2
      WHEN event_id % 1201 = 9 AND {own} THEN 77 WHEN {own} THEN {_MAPPED} ELSE 0 END AS DOUBLE) AS s{k}"""


_STUCK = "event_id % 500 BETWEEN 100 AND 109"
RAW = f"""
raw AS (
  SELECT {_DAY_FILE} AS source_file, event_id AS row_id, ts AS "timestamp", epoch_us(ts) AS us,
    {_head(1, _STUCK, "event_id % 2000 = 1610", "event_id % 4000")},
    {_head(2, _STUCK, "event_id % 701 = 0", "(event_id % 4000) // 2")},
    {_head(3, "event_id % 500 BETWEEN 200 AND 449", "false", "((event_id % 4000) // 3) * 2")}
  FROM events)"""

CLOCK = (
    RAW
    + """,
ticks AS (
  SELECT source_file, row_id, "timestamp", (us - lag(us) OVER (ORDER BY row_id)) / 1e6 AS step,
    (us - lag(us) OVER (PARTITION BY source_file ORDER BY row_id)) / 1e6 AS step_in_file
  FROM raw),
usual AS (
  SELECT source_file, quantile_cont(step, 0.5) AS with_boundary, quantile_cont(step_in_file, 0.5) AS in_file,
    quantile_cont(step_in_file, 0.5) FILTER (WHERE step_in_file > 0) AS positive
  FROM ticks GROUP BY source_file),
clock AS (
  SELECT t.*, u.in_file, u.positive,
    coalesce(step > 2 * CASE WHEN with_boundary > 0 THEN with_boundary ELSE 1.0 END, false) AS is_gap
  FROM ticks t JOIN usual u USING (source_file))"""
)

LONG = """
long AS (
  SELECT source_file, row_id, "timestamp", 'H01' AS head_id, c1 AS count, t1 AS torque_nm, s1 AS status_code FROM raw
  UNION ALL SELECT source_file, row_id, "timestamp", 'H02', c2, t2, s2 FROM raw
  UNION ALL SELECT source_file, row_id, "timestamp", 'H03', c3, t3, s3 FROM raw)"""

REPAIRED = (
    CLOCK
    + ","
    + LONG
    + """,
marked AS (
  SELECT *, coalesce(count = 0, false) AS z,
    coalesce(lag(count = 0) OVER f, false) AS pz, lead(count) OVER f AS next_count,
    lag(row_id) OVER f IS NULL AS file_first, lead(row_id) OVER f IS NULL AS file_last,
    last_value(count IGNORE NULLS) OVER (PARTITION BY head_id, source_file ORDER BY row_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known_before,
    first_value(nullif(count, 0) IGNORE NULLS) OVER (PARTITION BY head_id ORDER BY row_id
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later
  FROM long WINDOW f AS (PARTITION BY head_id, source_file ORDER BY row_id)),
numbered AS (
  SELECT *, sum(CASE WHEN z AND NOT pz THEN 1 ELSE 0 END)
    OVER (PARTITION BY head_id, source_file ORDER BY row_id) AS run FROM marked),
zero_runs AS (
  SELECT head_id, source_file, run, bool_or(file_first) AS at_start, first(known_before ORDER BY row_id) AS before,
    CASE WHEN bool_or(file_last) THEN last(later ORDER BY row_id) ELSE last(next_count ORDER BY row_id) END AS after
  FROM numbered WHERE z GROUP BY head_id, source_file, run),
placed AS (
  SELECT n.*, r.at_start, r.before, r.after,
    CASE WHEN NOT n.z THEN n.count WHEN r.at_start AND r.after IS NOT NULL THEN NULL
      WHEN NOT r.at_start AND r.before > 0 AND r.after >= r.before THEN NULL ELSE 0 END AS settled
  FROM numbered n LEFT JOIN zero_runs r
    ON n.z AND n.head_id = r.head_id AND n.source_file = r.source_file AND n.run = r.run),
judged AS (
  SELECT *, coalesce(z AND CASE WHEN at_start THEN carried ELSE before END > 0
    AND after >= CASE WHEN at_start THEN carried ELSE before END, false) AS masked
  FROM (SELECT *, last_value(settled IGNORE NULLS) OVER (PARTITION BY head_id ORDER BY row_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM placed)),
valid AS (SELECT *, CASE WHEN NOT masked THEN count END AS valid_count FROM judged),
changed AS (
  SELECT *, valid_count - previous_valid AS counter_delta
  FROM (SELECT *, last_value(valid_count IGNORE NULLS) OVER (PARTITION BY head_id ORDER BY row_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_valid FROM valid)),
repaired AS (
  SELECT c.source_file, c.row_id, c."timestamp", c.head_id, c.count, c.torque_nm, c.status_code, c.masked,
    c.valid_count, c.previous_valid, c.counter_delta, k.is_gap,
    CAST(sum(CASE WHEN c.counter_delta < 0 THEN 1 ELSE 0 END)
      OVER (PARTITION BY c.head_id ORDER BY c.row_id) AS BIGINT) AS segment_id,
    c.valid_count - lag(c.valid_count) OVER (PARTITION BY c.head_id, c.source_file ORDER BY c.row_id) AS step_count
  FROM changed c JOIN clock k USING (row_id))"""
)

IDLE = (
    CLOCK
    + """,
idle_rows AS (
  SELECT r.source_file, r.row_id, r.us, coalesce(s1 = 2, false) AND coalesce(s2 = 2, false) AND coalesce(s3 = 2, false) AS idle,
    c.step, c.step_in_file, c.positive
  FROM raw r JOIN clock c USING (row_id)),
idle_cut AS (
  SELECT *, CASE WHEN idle AND lag(idle) OVER (ORDER BY row_id) AND CASE WHEN step_in_file IS NULL
      THEN step <= 5 ELSE NOT coalesce(positive > 0 AND step_in_file > 2 * positive, false) END THEN 0 ELSE 1 END AS cut,
    CASE WHEN idle AND lag(idle) OVER (PARTITION BY source_file ORDER BY row_id)
      AND NOT coalesce(positive > 0 AND step_in_file > 2 * positive, false) THEN 0 ELSE 1 END AS cut_in_file,
    step_in_file IS NULL AS file_first,
    lead(row_id) OVER (PARTITION BY source_file ORDER BY row_id) IS NULL AS file_last
  FROM idle_rows),
idle_numbered AS (
  SELECT *, sum(cut) OVER (ORDER BY row_id) AS run,
    sum(cut_in_file) OVER (PARTITION BY source_file ORDER BY row_id) AS file_run FROM idle_cut),
idle_merged AS (
  SELECT make_timestamp(first(us ORDER BY row_id)) AS start_time, make_timestamp(last(us ORDER BY row_id)) AS end_time,
    count(*) AS n_rows, (last(us ORDER BY row_id) - first(us ORDER BY row_id)) / 1e6 AS duration_seconds
  FROM idle_numbered WHERE idle GROUP BY run),
idle AS (
  SELECT start_time, end_time, duration_seconds FROM idle_merged WHERE n_rows >= 30 OR duration_seconds >= 30)"""
)

PRODUCED = (
    TELE
    + ","
    + IDLE
    + """,
timed AS (SELECT * FROM real WHERE capping_speed_pph IS NOT NULL),
idle_ends AS (SELECT DISTINCT end_time FROM idle),
tagged AS (
  SELECT t.*, coalesce(t."timestamp" <= i.end_time, false) AS in_idle,
    coalesce(epoch_us(t."timestamp") - CAST(round(t.time_since_last_closure * 1e6) AS BIGINT) <= epoch_us(e.end_time)
      AND t."timestamp" > e.end_time, false) AS crosses_idle
  FROM timed t ASOF LEFT JOIN idle i ON t."timestamp" >= i.start_time
    ASOF LEFT JOIN idle_ends e ON t."timestamp" >= e.end_time),
produced AS (SELECT * FROM tagged WHERE NOT in_idle),
hourly AS (
  SELECT date_trunc('hour', "timestamp") AS hour, CAST(sum(inferred_closure_count) AS DOUBLE) AS pieces_per_hour,
    bool_or(data_quality = 'gap') AS gap_affected,
    CAST(sum(inferred_closure_count) FILTER (WHERE data_quality = 'gap') AS BIGINT) AS backlogged_closures
  FROM produced GROUP BY 1),
samples AS (SELECT * FROM produced WHERE NOT crosses_idle)"""
)

HEADS = (
    TELE
    + """,
heads AS (
  SELECT head_id, count(*) AS total_closures,
    CASE WHEN count(*) FILTER (WHERE status_code <> 2) > 0
      THEN count(*) FILTER (WHERE status_code <> 2 AND is_successful) END AS successful,
    CASE WHEN count(*) FILTER (WHERE status_code <> 2) > 0
      THEN count(*) FILTER (WHERE status_code <> 2 AND is_reject) END AS failed,
    avg(torque_nm) FILTER (WHERE status_code = 0) AS mean_torque_nm,
    stddev_samp(torque_nm) FILTER (WHERE status_code = 0) AS std_torque_nm
  FROM tele GROUP BY head_id),
compared AS (SELECT *, successful * 100.0 / nullif(successful + failed, 0) AS success_rate_pct FROM heads),
ranked AS (
  SELECT *,
    CASE WHEN success_rate_pct IS NOT NULL THEN CAST(rank() OVER (ORDER BY success_rate_pct DESC NULLS LAST) AS INTEGER) END AS rank_success_rate,
    CASE WHEN mean_torque_nm IS NOT NULL THEN CAST(rank() OVER (ORDER BY mean_torque_nm DESC NULLS LAST) AS INTEGER) END AS rank_mean_torque,
    CASE WHEN std_torque_nm IS NOT NULL THEN CAST(rank() OVER (ORDER BY std_torque_nm DESC NULLS LAST) AS INTEGER) END AS rank_torque_std,
    CAST(rank() OVER (ORDER BY total_closures DESC) AS INTEGER) AS rank_total_closures
  FROM compared),
long_metrics AS (
  SELECT head_id, 'success_rate_pct' AS metric, success_rate_pct AS value FROM compared
  UNION ALL SELECT head_id, 'mean_torque_nm', mean_torque_nm FROM compared
  UNION ALL SELECT head_id, 'std_torque_nm', std_torque_nm FROM compared),
flagged AS (
  SELECT head_id, metric, value, m AS group_avg, CASE WHEN value > m THEN 'higher' ELSE 'lower' END AS direction
  FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(value) OVER w AS n
    FROM long_metrics WINDOW w AS (PARTITION BY metric))
  WHERE n >= 2 AND sd > 0 AND abs(value - m) > 2 * sd)"""
)
