"""Which services and trips run on which day."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopline.functions.timefn import iso_weekday
from hopline.sources.schema import WEEKDAYS


def runs_on(day: Column) -> Column:
    """Whether the weekday flag of ``day`` is set."""
    return reduce(lambda a, b: a | b, ((iso_weekday(day) == i + 1) & (F.col(d) == 1) for i, d in enumerate(WEEKDAYS)))


def active_services(calendar: DataFrame, calendar_dates: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """(source, service_id, check_date): services that run on each date from ``first`` to ``last``.

    Rows of the calendar whose range and weekday flag cover a date, without the removals (exception 2), and the additions (exception 1). A service that is both
    removed and added on a date runs. The range is cut to the window before it is exploded, so a row gives at most as many rows as the window has days.
    """
    lo, hi = F.lit(first), F.lit(last)
    begin, end = F.greatest(F.col("start_date"), lo), F.least(F.col("end_date"), hi)
    days = calendar.where(begin <= end).withColumn("check_date", F.explode(F.sequence(begin, end)))
    regular = days.where(runs_on(F.col("check_date"))).select("source", "service_id", "check_date")
    marked = calendar_dates.where(F.col("date").between(lo, hi)).select("source", "service_id", F.col("date").alias("check_date"), "exception_type")
    removed = marked.where("exception_type = 2").drop("exception_type")
    added = marked.where("exception_type = 1").drop("exception_type")
    return regular.join(removed, ["source", "service_id", "check_date"], "left_anti").union(added).distinct()


def best_day(active: DataFrame) -> DataFrame:
    """(source, best_date, num_active_services): the date with most services of each source, the earliest of those that tie."""
    counts = active.groupBy("source", "check_date").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "check_date"))
    return counts.withColumn("k", rank).where("k = 1").select("source", F.col("check_date").alias("best_date"), F.col("n").alias("num_active_services"))


def valid_trips(trips: DataFrame, active: DataFrame, best: DataFrame) -> DataFrame:
    """(source, trip_id): trips whose service runs on their source's best day. One row for each trip, whatever repeats in the inputs."""
    on_best = active.join(best.select("source", F.col("best_date").alias("check_date")), ["source", "check_date"], "left_semi").select("source", "service_id")
    return trips.join(on_best, ["source", "service_id"], "left_semi").select("source", "trip_id").distinct()


def services_on(calendar: DataFrame, calendar_dates: DataFrame, day: dt.date) -> DataFrame:
    """(source, service_id) of one date."""
    return active_services(calendar, calendar_dates, day, day).select("source", "service_id")
