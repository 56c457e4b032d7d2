"""Unsigned 64-bit arithmetic carried in BIGINT.

Spark has no unsigned 64-bit type, and with ANSI on its sums and products raise
instead of wrapping. An expression keeps the mode in which its DataFrame was
built, so the wrapping ones are built inside :func:`wrapping`, and only those.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
_building = threading.RLock()


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """DataFrames built inside wrap on overflow; the session's mode comes back afterwards.

    Spark has no expression that wraps whatever the mode is, so the mode of the
    session is off while a plan is put together (some milliseconds; nothing runs
    in there). A lock keeps other threads of this library out. A plan that another
    thread analyses through the same session in that moment isn't ANSI either: give
    such threads a session of their own (``spark.newSession()``).
    """
    name = "spark.sql.ansi.enabled"
    with _building:
        before = spark.conf.get(name)
        spark.conf.set(name, "false")
        try:
            yield
        finally:
            spark.conf.set(name, before)


def signed(x: int) -> int:
    """The BIGINT that has the bits of an unsigned 64-bit integer."""
    x &= MASK64
    return x - (1 << 64) if x >> 63 else x


def lit64(x: int) -> Column:
    return F.lit(signed(x)).cast("bigint")


def srl(c: Column, n: int) -> Column:
    """Logical shift right."""
    return F.shiftrightunsigned(c, n)


def _big(x: int) -> Column:
    return F.lit(Decimal(x)).cast("decimal(20,0)")


def from_decimal(c: Column) -> Column:
    """DECIMAL(20,0) from 0 to 2^64-1 to the BIGINT with the same bits."""
    d = c.cast("decimal(20,0)")
    return F.when(d >= _big(1 << 63), (d - _big(1 << 64)).cast("decimal(20,0)")).otherwise(d).cast("bigint")


def to_decimal(c: Column) -> Column:
    d = c.cast("decimal(20,0)")
    return F.when(c < 0, (d + _big(1 << 64)).cast("decimal(20,0)")).otherwise(d)
