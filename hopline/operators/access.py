"""Who can be reached, and how long it takes to get going."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.functions.aggs import weighted_median
from hopline.functions.geo import edge_m, hex_cell, hex_center, hex_parent, hex_parent_at, with_rings


def trip_velocity(edges: DataFrame, extra_min: int = 5) -> DataFrame:
    """(source, trip_id, value): people per minute of a whole trip, with some minutes added to each hop."""
    return edges.groupBy("source", "trip_id").agg((F.sum("next_pop") / (F.sum("travel_time") + F.count(F.lit(1)) * extra_min)).alias("value"))


def velocity(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, value): mean, over hops, of their trips' people per minute."""
    t = edges.groupBy("source", "trip_id").agg((F.sum("next_pop") / F.sum("travel_time")).alias("v"))
    return edges.join(t, ["source", "trip_id"]).groupBy(*by).agg(F.avg("v").alias("value"))


def stop_rates(edges: DataFrame, awake_hours: int, stop: str = "stop_id") -> DataFrame:
    """Each stop's people per minute, departures and mean wait (half the time between them), of waits up to 55 minutes."""
    rated = edges.join(trip_velocity(edges), ["source", "trip_id"]).groupBy("source", stop, "stop_lat", "stop_lon")
    rated = rated.agg(F.avg("value").alias("ppm"), F.count(F.lit(1)).alias("departs"))
    return rated.withColumn("wait", F.lit(awake_hours * 60.0) / (F.col("departs") * 2)).where("wait <= 55")


def walk_minutes(ring: Column, res: int, speed: float) -> Column:
    """Through ``ring`` cells and half the first one, at metres per minute."""
    return (ring * 2 + 1) * F.lit(edge_m(res)) / F.lit(speed)


def pop_within_60(edges: DataFrame, res: int = 10, max_ring: int = 30, walk: float = 40.0, awake_hours: int = 18) -> DataFrame:
    """(lon, lat, pop_in_60, cell): people within an hour of each cell: walk, wait, ride, and five minutes at the end.

    One stop speaks for each cell (most people), before the cell is exploded to its rings; the maximum over the cells that are reached is a partial
    aggregate, and the ring table has 1 + 3k(k + 1) rows.
    """
    s = stop_rates(edges, awake_hours).withColumn("cell", hex_cell(F.col("stop_lat"), F.col("stop_lon"), res))
    reach = F.greatest(F.lit(0.0), (F.lit(55.0) - F.col("wait")) * F.col("ppm"))
    best = s.groupBy("cell").agg(F.max(F.struct(reach.alias("reach"), F.col("ppm"), (-F.col("wait")).alias("w"))).alias("b"))
    spread = with_rings(best, max_ring).select((F.col("cell") + F.col("delta")).alias("cell"), "k", F.col("b.ppm").alias("ppm"), (-F.col("b.w")).alias("wait"))
    value = (F.lit(55.0) - walk_minutes(F.col("k"), res, walk) - F.col("wait")) * F.col("ppm")
    out = spread.groupBy("cell").agg(F.max(value).alias("pop_in_60")).where("pop_in_60 > 0")
    lat, lon = hex_center(F.col("cell"))
    return out.select(lon.alias("lon"), lat.alias("lat"), "pop_in_60", "cell")


def bake(pop60: DataFrame, resolutions: range = range(4, 10), own: int = 10) -> DataFrame:
    """``pop60`` at its own resolution and, by parent cells, at coarser ones: mean place, median people. One union, so a rerun adds nothing twice."""
    up = pop60.select("lon", "lat", "pop_in_60", F.explode(F.array(*map(F.lit, resolutions))).alias("res"))
    up = up.withColumn("cell", hex_parent_at(F.col("lat"), F.col("lon"), F.col("res")))  # a cell's place is its middle
    rolled = up.groupBy("cell", "res").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.median("pop_in_60").alias("pop_in_60"))
    cols = ["lon", "lat", "pop_in_60", "cell", "res"]
    return pop60.withColumn("res", F.lit(own)).select(*cols).unionByName(rolled.select(*cols))


def time_to_transport(day: DataFrame, inhabited: DataFrame | None = None, res: int = 10, max_ring: int = 30, walk: float = 40.0, awake_hours: int = 18) -> DataFrame:
    """(cell, time_to_transport): least walk and wait from each cell, up to an hour; only cells of ``inhabited`` (cell) if given."""
    calls = day.groupBy("source", "stop_id", "stop_lat", "stop_lon").agg(F.count(F.lit(1)).alias("n"))
    most = calls.groupBy(hex_cell(F.col("stop_lat"), F.col("stop_lon"), res).alias("cell")).agg(F.max("n").alias("n"))
    spread = with_rings(most, max_ring).select((F.col("cell") + F.col("delta")).alias("cell"), "k", "n")
    t = F.lit(awake_hours * 60.0) / (F.col("n") * 2) + walk_minutes(F.col("k"), res, walk)
    out = spread.groupBy("cell").agg(F.min(t).alias("time_to_transport")).where("time_to_transport <= 60")
    return out if inhabited is None else out.join(inhabited.select("cell").distinct(), "cell", "left_semi")


def time_to_transport_coarse(times: DataFrame, population: DataFrame, fine: int = 9, coarse: int = 2) -> DataFrame:
    """(cell, value): median by parent at ``fine``, and of those the exact median by people at ``coarse``; where people have no time, 60."""
    mid = times.groupBy(hex_parent(F.col("cell"), fine).alias("cell")).agg(F.median("time_to_transport").alias("t"))
    both = population.join(mid, "cell", "left").select(hex_parent(F.col("cell"), coarse).alias("cell"), F.coalesce("t", F.lit(60.0)).alias("t"), "population")
    return weighted_median(both, ["cell"], "t", "population")


def uninhabited(pop60: DataFrame, inhabited: DataFrame, min_pop: float = 2e6) -> DataFrame:
    """(cell, value): cells where nobody lives from which many can be reached."""
    return pop60.join(inhabited.select("cell").distinct(), "cell", "left_anti").where(F.col("pop_in_60") > min_pop).select("cell", F.col("pop_in_60").alias("value"))
