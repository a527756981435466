"""Fixed values of the telemetry format.

Everything here is data that results depend on: the status codes of the
machine controller, the column pattern of its CSV export, and the thresholds
used by the detectors.
"""

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
TIMESTAMP = "timestamp"
HEAD_COLUMN = r"^(H\d{2})\s+(Count|AppTorque|Status)$"
HEAD_FIELDS = ("Count", "AppTorque", "Status")
MAX_HEAD_IDS = 100  # H00..H99: a head id has exactly two digits

# code: (label, is_reject)
STATUS = {
    0: ("Closure OK", False),
    2: ("No Load", False),
    3: ("SlowTorque", True),
    4: ("No Closure", False),
    5: ("ClosureTorque", True),
    8: ("No InTorque", False),
    9: ("EarlyRaise", True),
    16: ("No CapTurns", False),
    17: ("InsufficientCapTurns", True),
    32: ("Following Error", False),
    33: ("TrackingError", True),
    64: ("Bad Closure", False),
    65: ("RotatingAtRaise", True),
}
SUCCESS_CODE = 0
IDLE_CODE = 2
UNKNOWN_LABEL = "Unknown"

IDLE_MIN_ROWS = 30
IDLE_MIN_SECONDS = 30.0
GAP_FACTOR = 2.0
FILE_BOUNDARY_SECONDS = 5.0
FALLBACK_INTERVAL_SECONDS = 1.0

QUALITY_SINGLE = "single"
QUALITY_AGGREGATED = "aggregated"
QUALITY_GAP = "gap"
# ----------------------------------------------------------------------------

REJECT_CODES = tuple(code for code, (_, reject) in STATUS.items() if reject)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("head_id", T.StringType()),
        T.StructField("head_number", T.IntegerType()),
        T.StructField("counter", T.LongType()),
        T.StructField("counter_delta", T.LongType()),
        T.StructField("inferred_closure_count", T.LongType()),
        T.StructField("data_quality", T.StringType()),
        T.StructField("torque_nm", T.DoubleType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("status_label", T.StringType()),
        T.StructField("is_reject", T.BooleanType()),
        T.StructField("is_successful", T.BooleanType()),
        T.StructField("classification", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("time_since_last_closure", T.DoubleType()),
        T.StructField("capping_speed_pph", T.DoubleType()),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

IDLE_SCHEMA = T.StructType(
    [
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("duration_seconds", T.DoubleType()),
    ]
)

# What an anomaly says of its torque, before the reading and before the bound.
REASON_BELOW = ("torque ", " Nm below expected lower bound ")
REASON_ABOVE = ("torque ", " Nm above expected upper bound ")
