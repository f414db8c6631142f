"""Times of a service day as seconds since its start, and what is asked of them. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def seconds_of(text: Column) -> Column:
    """``HH:MM:SS`` (hours may pass 24) -> seconds; null if malformed."""
    part = lambda i: F.split(F.trim(text), ":")[i].cast("int")
    return F.when(F.trim(text).rlike(r"^\d{1,3}:[0-5]\d:[0-5]\d$"), part(0) * 3600 + part(1) * 60 + part(2))


def on_day(day: Column, seconds: Column) -> Column:
    """The wall-clock timestamp of a service-day second."""
    return (day.cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).cast("timestamp_ntz")


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed between two service-day seconds, not whole minutes elapsed."""
    return (F.floor(end / 60) - F.floor(start / 60)).cast("int")


def timestamp_minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed between two timestamps."""
    return F.timestamp_diff("MINUTE", F.date_trunc("minute", start), F.date_trunc("minute", end))


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def iso_weekday(day: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return (F.weekday(day) + 1).cast("int")


def time_of_day(ts: Column) -> Column:
    """Seconds since midnight."""
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("int")


def tumble_hour(seconds: Column) -> Column:
    """First second of the hour."""
    return (F.floor(seconds / 3600) * 3600).cast("int")


def clock(seconds: Column) -> Column:
    """Seconds -> ``HH:MM:SS``."""
    return F.concat_ws(":", *(F.lpad(F.floor(x).cast("string"), 2, "0") for x in (seconds / 3600, (seconds % 3600) / 60, seconds % 60)))


def date_or_zero(text: Column) -> Column:
    """``yyyyMMdd`` -> date, 1970-01-01 if malformed."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"), F.lit("1970-01-01").cast("date"))
