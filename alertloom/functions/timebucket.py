"""epoch-aligned floor of a timestamp to N seconds (start inclusive).

Works on ``TIMESTAMP_NTZ`` with integer microseconds, so the result does not depend on the
session time zone, and the bucket length may be a column (one pass over several sizes).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def to_micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ (or TIMESTAMP, read as wall clock)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), col.cast("timestamp_ntz"))


def from_micros(us: Column) -> Column:
    """Inverse of :func:`to_micros`; returns TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", us, F.expr(_EPOCH))


def floor_micros(us: Column, seconds: Column | int) -> Column:
    size = (F.lit(seconds) if isinstance(seconds, int) else seconds).cast("long") * F.lit(1_000_000)
    return us - F.pmod(us, size)


def floor_ts(ts: Column | str, seconds: Column | int) -> Column:
    """Window start of ``ts`` for windows of ``seconds`` (TIMESTAMP_NTZ)."""
    return from_micros(floor_micros(to_micros(ts), seconds))
