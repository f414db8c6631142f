"""The denormalised day and its stopping patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the day takes from each table, besides the keys; columns that a table lacks are left out.
FROM_STOP_TIMES = ["arrival_time", "departure_time", "stop_id", "trip_id", "source", "stop_sequence", "stop_headsign", "pickup_type", "drop_off_type", "continuous_pickup", "continuous_drop_off", "shape_dist_traveled", "timepoint", "local_zone_id"]
FROM_TRIPS = ["bikes_allowed", "block_id", "service_id", "direction_id", "wheelchair_accessible", "trip_headsign", "trip_short_name", "shape_id"]
FROM_ROUTES = ["route_id", "route_short_name", "route_long_name", "route_desc", "route_type", "route_url", "route_color", "route_text_color", "route_sort_order"]
FROM_STOPS = ["stop_code", "stop_name", "stop_desc", "stop_lat", "stop_lon", "zone_id", "stop_url", "location_type", "parent_station", "stop_timezone", "wheelchair_boarding", "level_id", "platform_code"]


def on_source(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that are unique only within a source."""
    return left.join(right, [*keys, "source"], how)


def one_day(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Stop times with all of their trip, route and stop. The small sides (routes, stops) are broadcast where they fit, by the planner's own size check."""
    pick = lambda df, cols: [c for c in cols if c in df.columns]
    tr = trips.select("source", "trip_id", "route_id", *pick(trips, FROM_TRIPS))
    renamed = [F.col(c).alias(f"route_{c}") for c in pick(routes, ["continuous_pickup", "continuous_drop_off"])]
    ro = routes.select("source", *pick(routes, FROM_ROUTES), *renamed)
    sp = stops.select("source", "stop_id", *pick(stops, FROM_STOPS))
    st = stop_times.select(*pick(stop_times, FROM_STOP_TIMES))
    out = on_source(on_source(on_source(st, tr, ["trip_id"]), ro, ["route_id"]), sp, ["stop_id"])
    order = [*FROM_STOP_TIMES, *FROM_TRIPS, *FROM_ROUTES, "route_continuous_pickup", "route_continuous_drop_off", *FROM_STOPS]
    return out.select(*(c for c in order if c in out.columns))


def only_valid(stop_times: DataFrame, valid: DataFrame) -> DataFrame:
    """Stop times of the valid trips, before anything is written."""
    return stop_times.join(valid, ["source", "trip_id"], "left_semi")


def stopping_patterns(day: DataFrame) -> DataFrame:
    """(source, trip_id, sane_route_id, n_stops): trips of a source with the same stops in the same order share an id.

    The order is by departure, then stop sequence, then stop. The id is a hash of source and stops, so a rerun gives the same one.
    """
    stop = F.struct("departure_time", "stop_sequence", "stop_id")
    lists = day.groupBy("source", "trip_id").agg(F.transform(F.array_sort(F.collect_list(stop)), lambda s: s["stop_id"]).alias("stops"))
    return lists.select("source", "trip_id", F.xxhash64("source", "stops").alias("sane_route_id"), F.size("stops").alias("n_stops"))


def with_patterns(day: DataFrame) -> DataFrame:
    return on_source(day, stopping_patterns(day).drop("n_stops"), ["trip_id"])
