"""Timestamp helpers. Inputs may be TIMESTAMP or TIMESTAMP_NTZ; the
differences are taken without any time-zone conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions._col import col


def duration_ms(start: Column | str, end: Column | str, fractional: bool = False) -> Column:
    """Elapsed ms between two instants; NULL if either is missing.

    whole: truncated integer ms (BigInt division); fractional: micros / 1000.
    """
    micros = F.timestamp_diff("MICROSECOND", col(start), col(end))
    if fractional:
        return micros / F.lit(1000.0)
    # integer division that truncates toward zero, like BigInt division
    return F.call_function("div", micros, F.lit(1000))


def iso_text(ts: Column | str) -> Column:
    """ISO-8601 UTC text with milliseconds, e.g. 2024-01-01T00:00:07.179Z."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_date(ts: Column | str) -> Column:
    """Date part of an ISO timestamp as 'yyyy-MM-dd'."""
    return F.date_format(col(ts), "yyyy-MM-dd")
