"""Column expressions shared by the operators. All of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindle.constants import IDLE_CODE, REJECT_CODES, STATUS, SUCCESS_CODE, UNKNOWN_LABEL


def micros(ts) -> Column:
    """A naive timestamp as microseconds, so that it can be added and sliced."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def from_micros(us) -> Column:
    return F.timestamp_micros(_col(us)).cast("timestamp_ntz")


def seconds_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(1_000_000.0)


def day(ts) -> Column:
    return F.date_trunc("day", _col(ts)).cast("timestamp_ntz")


def hour(ts) -> Column:
    return F.date_trunc("hour", _col(ts)).cast("timestamp_ntz")


def ratio(numerator, denominator) -> Column:
    """Division that yields null, not an error, on a zero denominator."""
    return _col(numerator) / F.nullif(_col(denominator).cast("double"), F.lit(0.0))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def success_rate(successful, failed) -> Column:
    """Percent of the observations that are clearly good or clearly bad."""
    good, bad = _col(successful), _col(failed)
    return ratio(good * F.lit(100.0), good + bad)


def status_label(code) -> Column:
    pairs = [F.lit(x) for code_, (label, _) in STATUS.items() for x in (code_, label)]
    return F.coalesce(F.create_map(*pairs)[_col(code)], F.lit(UNKNOWN_LABEL))


def is_reject(code) -> Column:
    return F.coalesce(_col(code).isin(*REJECT_CODES), F.lit(False))


def is_successful(code) -> Column:
    return F.coalesce(_col(code) == SUCCESS_CODE, F.lit(False))


def classification(code) -> Column:
    code = _col(code)
    return (
        F.when(code == SUCCESS_CODE, "successful")
        .when(code.isin(*REJECT_CODES), "failed")
        .when(code == IDLE_CODE, "no_load")
        .otherwise("other")
    )


def format_percentage(value, suffix: str = "%") -> Column:
    """Two decimals, but four next to 0 and 100 so that a rare failure never
    reads as a perfect rate; n/a without a value."""
    value = _col(value)
    near_edge = ((value > 0) & (value < 0.01)) | ((value > 99.99) & (value < 100))
    return (
        F.when(value.isNull() | F.isnan(value), "n/a")
        .when(near_edge, F.format_string("%.4f" + suffix.replace("%", "%%"), value))
        .otherwise(F.format_string("%.2f" + suffix.replace("%", "%%"), value))
    )


def null_if_nan(value) -> Column:
    value = _col(value)
    return F.when(~F.isnan(value), value)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
