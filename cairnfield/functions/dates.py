"""OLE dates: days since 1899-12-30 as a double, the fraction being the time of day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OLE_EPOCH = dt.date(1899, 12, 30)
#: Days from the epoch of OLE dates to that of Unix.
UNIX_DAYS = 25569
DAY_SECONDS = 86400


def ole_double(col: Column, kind: T.DataType) -> Column:
    """A date, timestamp or struct with `ts` as an OLE date."""
    if isinstance(kind, T.DateType):
        return (F.unix_date(col) + UNIX_DAYS).cast("double")
    if isinstance(kind, T.StructType):
        return ole_double(col["ts"], kind["ts"].dataType)
    micros = F.unix_micros(col) if isinstance(kind, T.TimestampType) else F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), col).cast("timestamp"))
    return micros / (DAY_SECONDS * 1e6) + UNIX_DAYS


def ole_seconds(value: Column) -> Column:
    """Unix seconds of an OLE date, the time of day rounded to seconds. A negative date's fraction counts forward from its day."""
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    fraction = value - whole
    # days before the epoch: the integral part moves up one day, the fraction is what is then left
    whole = F.when((value < 0) & (fraction != 0), whole + 1).otherwise(whole)
    seconds = (value - whole) * DAY_SECONDS
    rounded = F.signum(seconds) * F.floor(F.abs(seconds) + 0.5)
    return ((whole - UNIX_DAYS) * DAY_SECONDS + rounded).cast("long")


def ole_timestamp(value: Column) -> Column:
    return F.timestamp_seconds(ole_seconds(value))


def ole_text(value: Column, part: str = "datetime") -> Column:
    """Text of an OLE date: datetime, date or time."""
    pattern = {"datetime": "yyyy-MM-dd HH:mm:ss", "date": "yyyy-MM-dd", "time": "HH:mm:ss"}[part]
    return F.date_format(ole_timestamp(value), pattern)


def offset_minutes(flag: Column) -> Column:
    """Minutes of a time-zone flag of quarter hours around 100 (100: UTC), from 2 to 198; other flags say nothing and give 0."""
    return F.when(flag.between(2, 198), (flag - 100) * 15).when(flag.isNotNull(), 0)
