"""Look-back windows. The clock enters only through ``as_of``; None means now."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

Clock = date | datetime | None


def timestamp(value: date | datetime) -> Column:
    """Zone-less timestamp literal, foldable and so pushed down to the Parquet reader."""
    if not isinstance(value, datetime):
        value = datetime.combine(value, time())
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def now(as_of: Clock = None) -> Column:
    return F.localtimestamp() if as_of is None else timestamp(as_of)


def days_before_midnight(days: int, as_of: Clock = None) -> Column:
    """Midnight ``days`` days before the current date."""
    if as_of is None:
        return F.date_sub(F.current_date(), days).cast("timestamp_ntz")
    day = as_of.date() if isinstance(as_of, datetime) else as_of
    return timestamp(day - timedelta(days=days))


def days_before_now(days: int, as_of: Clock = None) -> Column:
    """The moment exactly ``days`` days ago."""
    if as_of is None:
        return F.localtimestamp() - F.expr(f"interval {int(days)} days")
    if not isinstance(as_of, datetime):
        as_of = datetime.combine(as_of, time())
    return timestamp(as_of - timedelta(days=days))


def age_in_days(created_at: Column, as_of: Clock = None) -> Column:
    """Fractional days since ``created_at``, never negative."""
    micros = F.timestamp_diff("MICROSECOND", created_at, now(as_of))
    return F.greatest(micros / F.lit(86_400_000_000.0), F.lit(0.0))


def iso_utc(text: Column) -> Column:
    """ISO text as UTC wall time: an offset is applied, text without one is UTC; NULL if malformed."""
    offset = text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    local = text.try_cast("timestamp").cast("timestamp_ntz")
    shifted = F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
    return F.when(offset, shifted).otherwise(text.try_cast("timestamp_ntz"))


def iso_or_now(text: Column, as_of: Clock = None) -> Column:
    return F.coalesce(iso_utc(text), now(as_of))


def epoch(seconds: Column) -> Column:
    """Epoch seconds as UTC wall time, whatever the session zone; NULL becomes the epoch itself."""
    micros = (F.coalesce(seconds, F.lit(0)) * F.lit(1_000_000)).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
