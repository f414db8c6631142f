"""Columns of the timetable files and how each is typed after reading as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopline.functions.timefn import date_or_zero, seconds_of

#: table -> column -> type. text: '' where absent; int?: null if malformed; int0, double0: 0 if malformed; int!: an error if malformed.
TABLES: dict[str, dict[str, str]] = {
    "routes": {
        "route_id": "text", "agency_id": "text", "route_short_name": "text", "route_long_name": "text", "route_desc": "text", "route_type": "int!",
        "route_url": "text", "route_color": "text", "route_text_color": "text", "route_sort_order": "long?", "continuous_pickup": "int?", "continuous_drop_off": "int?",
    },
    "trips": {
        "route_id": "text", "service_id": "text", "trip_id": "text", "trip_headsign": "text", "trip_short_name": "text", "direction_id": "int?",
        "block_id": "text", "shape_id": "text", "wheelchair_accessible": "int?", "bikes_allowed": "int?",
    },
    "stops": {
        "stop_id": "text", "stop_code": "text", "stop_name": "text", "stop_desc": "text", "stop_lat": "double0", "stop_lon": "double0", "zone_id": "text",
        "stop_url": "text", "location_type": "int?", "parent_station": "text", "stop_timezone": "text", "wheelchair_boarding": "int?", "level_id": "text", "platform_code": "text",
    },
    "calendar": {
        "service_id": "text", **{d: "int0" for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")}, "start_date": "date0", "end_date": "date0",
    },
    "calendar_dates": {"service_id": "text", "date": "date0", "exception_type": "int0"},
    "agency": {c: "text" for c in ("agency_id", "agency_name", "agency_url", "agency_timezone", "agency_email", "agency_fare_url", "agency_lang", "agency_phone")},
    "stop_times": {
        "trip_id": "text", "arrival_time": "seconds", "departure_time": "seconds", "stop_id": "text", "stop_sequence": "int?", "stop_headsign": "text", "pickup_type": "int?",
        "drop_off_type": "int?", "continuous_pickup": "int?", "continuous_drop_off": "int?", "shape_dist_traveled": "float?", "timepoint": "int?", "local_zone_id": "text",
    },
}

#: Sort keys within a source, by the way each table is read.
SORT_KEYS: dict[str, list[str]] = {
    "routes": ["source", "route_id", "route_type"],
    "trips": ["source", "route_id", "service_id", "trip_id"],
    "stops": ["source", "stop_id", "stop_lat", "stop_lon"],
    "calendar": ["source", "service_id", "start_date", "end_date"],
    "calendar_dates": ["source", "service_id", "date", "exception_type"],
    "agency": ["source", "agency_id"],
    "stop_times": ["source", "trip_id", "stop_id", "arrival_time", "departure_time"],
}

WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def typed(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    tried = lambda t: c.try_cast(t)
    out = {
        "text": lambda: F.coalesce(c, F.lit("")),
        "int!": lambda: c.cast("int"),
        "int?": lambda: tried("int"),
        "long?": lambda: tried("long"),
        "float?": lambda: tried("float"),
        "int0": lambda: F.coalesce(tried("int"), F.lit(0)),
        "double0": lambda: F.coalesce(tried("double"), F.lit(0.0)),
        "date0": lambda: date_or_zero(c),
        "seconds": lambda: seconds_of(c),
    }[kind]()
    return out.alias(name)
