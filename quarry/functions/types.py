"""Logical types that Spark lacks, as expressions over the integers that store them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.errors import Unsupported

#: Ticks in a second.
UNITS = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}


def unsigned(col: Column, bits: int) -> Column:
    """An unsigned integer kept in a signed one of the same width, in the next wider type; 64 bits as decimal(20,0)."""
    wide = {8: "smallint", 16: "int", 32: "bigint", 64: "decimal(20,0)"}.get(bits)
    if wide is None:
        raise Unsupported(f"integers of {bits} bits")
    c = col.cast(wide)
    return F.when(c < 0, c + F.lit(str(1 << bits)).cast("decimal(20,0)")).otherwise(c).cast(wide)


def wrapped(total: Column) -> Column:
    """A decimal sum modulo 2**64, as a signed 64-bit integer."""
    span, half = F.lit(str(1 << 64)).cast("decimal(38,0)"), F.lit(str(1 << 63)).cast("decimal(38,0)")
    return (F.pmod(total.cast("decimal(38,0)") + half, span) - half).cast("bigint")


def timestamp(ticks: Column, unit: str, tz: str = "") -> Column:
    """Ticks since the epoch.  Nanoseconds stay numbers, as Spark would cut them off; without a zone it is a local timestamp."""
    if unit not in UNITS:
        raise Unsupported(f"time unit {unit!r}")
    if unit == "ns":
        return ticks.cast("bigint")
    stamp = F.timestamp_micros(ticks.cast("bigint") * F.lit(UNITS["us"] // UNITS[unit]))
    return stamp if tz else F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=ticks.cast("decimal(38,6)") / F.lit(UNITS[unit]))


def date32(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int"))


def date64(millis: Column, other: str = "error") -> Column:
    """Days counted in milliseconds.  A count that is no whole day is an error; with other="timestamp" all become local timestamps, which hold it."""
    if other == "timestamp":
        return timestamp(millis, "ms")
    day = F.lit(86_400_000)
    whole = F.date_from_unix_date(F.floor(millis / day).cast("int"))
    return F.when(F.pmod(millis, day) == 0, whole).when(millis.isNotNull(), F.raise_error(F.concat(F.lit("no whole day: "), millis.cast("string"))).cast("date"))


def time_of_day(ticks: Column, unit: str) -> Column:
    """Ticks since midnight as a day-time interval, to the microsecond; nanoseconds that are none stay numbers as a whole column."""
    if unit not in UNITS:
        raise Unsupported(f"time unit {unit!r}")
    if unit == "ns":
        return ticks.cast("bigint")
    return F.make_dt_interval(secs=ticks.cast("decimal(38,6)") / F.lit(UNITS[unit]))


def decimal_from_unscaled(unscaled: Column, precision: int, scale: int) -> Column:
    """The integer times the literal 10**-scale, which is exact."""
    if not 1 <= precision <= 38:
        raise Unsupported(f"decimals of {precision} digits")
    unit = F.lit("1" if not scale else "0." + "0" * (scale - 1) + "1").cast(f"decimal({scale + 1},{scale})")
    return (unscaled.cast("decimal(19,0)") * unit).cast(f"decimal({precision},{scale})")
