"""Integer slide arithmetic.

Windows are addressed by the index of their end: ``e`` covers
``[(e - length) * batch, e * batch)``.  Integer indices keep the hop
expansion and every join key a plain ``bigint`` (cheap to hash and sort) and
avoid floating-point bucket edges.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def slot_index(ts: Column | str, batch_us: int) -> Column:
    """``floor(epoch_micros(ts) / batch_us)`` in exact integer arithmetic."""
    col = F.col(ts) if isinstance(ts, str) else ts
    us = F.unix_micros(col)
    b = F.lit(batch_us).cast("long")
    return F.call_function("div", us - F.pmod(us, b), b)


def end_timestamp(idx: Column | str, batch_us: int) -> Column:
    """Window end as ``timestamp_ntz`` (UTC wall clock) from its index, whatever
    the session's time zone."""
    col = F.col(idx) if isinstance(idx, str) else idx
    return F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.lit(timedelta(microseconds=batch_us)) * col
