"""From stop times to hops between stops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopline.functions.geo import hex_cell, hex_disk, hex_distance
from hopline.functions.timefn import minutes_between
from hopline.session import materialize


def along_trip():
    return W.partitionBy("source", "trip_id").orderBy("arrival_time", "stop_sequence")


def hops(day: DataFrame, stop: str = "stop_id") -> DataFrame:
    """Each stop time with next_stop, next_arrival, next_lat, next_lon and travel_time in minute boundaries; the last of a trip is its own next.

    Hops to the same stop and hops within a minute are left out, the second as the reference does: it also drops the last stop.
    """
    nxt = {"next_stop": stop, "next_arrival": "arrival_time", "next_lat": "stop_lat", "next_lon": "stop_lon"}
    out = day.withColumns({n: F.coalesce(F.lead(c).over(along_trip()), F.col(c)) for n, c in nxt.items()})
    out = out.withColumn("travel_time", minutes_between(F.col("departure_time"), F.col("next_arrival")))
    return out.where((F.col("next_stop") != F.col(stop)) & (F.col("travel_time") > 0))


def not_of(df: DataFrame, countries: tuple[str, ...]) -> DataFrame:
    """Without the sources that begin with one of the prefixes."""
    for c in countries:
        df = df.where(~F.col("source").startswith(c))
    return df


def edge_list(day: DataFrame, population: DataFrame, stop: str = "stop_id", res: int = 9, k: int = 4, exclude: tuple[str, ...] = ("us", "ca")) -> DataFrame:
    """Hops with next_pop: the people around this stop that are not also around the next one (disks of ``k`` steps).

    ``population`` is (cell, population) at ``res``. The people of a whole disk are added up once for each distinct cell. Disks more than 2k steps apart do
    not meet, so the whole disk counts; only for nearer pairs of cells, of which a cell has 1 + 6k(2k + 1) at most, is the difference of the disks taken.
    Hops whose difference holds nobody are left out. The hops are written once, as three steps read them.
    """
    names = [x for x in ("route_type",) if x in day.columns]
    shown = ["source", "trip_id", stop, "stop_sequence", "stop_lat", "stop_lon", "departure_time", "next_stop", "next_arrival", "travel_time", *names]
    h = hops(not_of(day, exclude), stop)
    h = h.select(*shown, hex_cell(F.col("stop_lat"), F.col("stop_lon"), res).alias("c"), hex_cell(F.col("next_lat"), F.col("next_lon"), res).alias("nc"))
    h = materialize(h.withColumn("near", hex_distance(F.col("c"), F.col("nc")) <= 2 * k), "hops")
    people = population.select("cell", "population")
    around = h.select("c").distinct().withColumn("cell", F.explode(hex_disk(F.col("c"), k))).join(people, "cell").groupBy("c").agg(F.sum("population").alias("next_pop"))
    pairs = h.where("near").select("c", "nc").distinct()
    gone = pairs.select("c", "nc", F.explode(F.array_except(hex_disk(F.col("c"), k), hex_disk(F.col("nc"), k))).alias("cell"))
    near = gone.join(people, "cell").groupBy("c", "nc").agg(F.sum("population").alias("next_pop"))
    out = h.where("not near").join(around, "c").select(*shown, "next_pop").unionByName(h.where("near").join(near, ["c", "nc"]).select(*shown, "next_pop"))
    return out.withColumn("pop_per_minute", F.col("next_pop") / F.col("travel_time"))


def edge_list_ext(day: DataFrame, stop: str = "stop_id", res: int = 11) -> DataFrame:
    """Hops with next, first and last stop of the trip, cells, and what is shown of the route. One window specification, one shuffle."""
    full = along_trip().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = {"stop": stop, "arrival": "arrival_time", "lat": "stop_lat", "lon": "stop_lon", "name": "stop_name"}
    out = day.withColumns(
        {f"initial_{n}": F.first(c).over(full) for n, c in ends.items()} | {f"final_{n}": F.last(c).over(full) for n, c in ends.items()}
    )
    out = hops(out, stop).withColumn("cell", hex_cell(F.col("stop_lat"), F.col("stop_lon"), res)).withColumn("next_cell", hex_cell(F.col("next_lat"), F.col("next_lon"), res))
    shown = [c for c in ("route_type", "stop_name", "route_short_name", "route_long_name", "trip_headsign", "sane_route_id", "route_color", "route_text_color") if c in out.columns]
    return out.select(
        "source", "trip_id", stop, "stop_sequence", "stop_lat", "stop_lon", "arrival_time", "cell", "next_cell", "departure_time", "next_stop", "next_arrival", "next_lat", "next_lon",
        *(f"{w}_{n}" for w in ("final", "initial") for n in ends), "travel_time", *shown,
    )


def edge_export(edges: DataFrame, stop: str = "stop_uuid", res: int = 7) -> DataFrame:
    """(stop, cell, next_stop, departure_time, next_arrival) for the router, without nulls, by departure."""
    out = edges.select(stop, hex_cell(F.col("stop_lat"), F.col("stop_lon"), res).alias("cell"), "next_stop", "departure_time", "next_arrival")
    return out.dropna().orderBy("departure_time", stop, "next_stop", "next_arrival")
