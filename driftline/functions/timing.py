"""Time arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MICROS = 86_400_000_000
# Julian date of 1970-01-01 and offset of the day count that starts at 1949-12-31 00:00.
JULIAN_OF_1970 = 2440587.5
JULIAN_OF_1949_12_31 = 2433281.5


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time column; integer columns pass through."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(
            f"(`{name}` - timestamp_ntz'1970-01-01 00:00:00') div interval '0.000001' second")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("bigint")
    raise TypeError(f"{name} is {kind.simpleString()}, not a time")


def days(span_micros: Column) -> Column:
    return span_micros / F.lit(float(DAY_MICROS))


def julian_date(us: Column) -> Column:
    return days(us) + F.lit(JULIAN_OF_1970)


def days_since_1949(us: Column) -> Column:
    return julian_date(us) - F.lit(JULIAN_OF_1949_12_31)
