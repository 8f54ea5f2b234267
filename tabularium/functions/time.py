"""Zone-free arithmetic on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970-01-01 as DECIMAL(18,6), without going through the session zone."""
    ts = col(ts)
    return (
        F.unix_date(ts.cast("date")) * F.lit(DAY_SECONDS)
        + F.hour(ts) * F.lit(3600)
        + F.minute(ts) * F.lit(60)
        + F.date_part(F.lit("SECOND"), ts)
    ).cast("decimal(18,6)")


def whole_days_between(start: Column | str, end: Column | str) -> Column:
    """Complete 24-hour days from start to end."""
    return F.floor((epoch_seconds(end) - epoch_seconds(start)) / F.lit(DAY_SECONDS)).cast("long")


def day_key(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
