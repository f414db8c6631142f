"""Earliest arrivals over timed hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopline.functions.geo import hex_cell, with_rings
from hopline.session import discard, materialize


def earliest_arrivals(edges: DataFrame, starts: DataFrame, t0: int, cutoff: int) -> DataFrame:
    """(stop, arrival_time): label correcting in rounds. ``edges``: stop, next_stop, departure_time, next_arrival (s); ``starts``: stop.

    A round joins the stops whose arrival improved with the hops that leave them afterwards, and keeps what beats the known arrivals. Hops outside
    [t0, cutoff] go first. Each round is written to the shared folder. No change time and no walking between stops. It ends when no arrival improves,
    after as many rounds as the longest of the best paths has hops.
    """
    e = materialize(
        edges.select("stop", "next_stop", "departure_time", "next_arrival").where((F.col("departure_time") >= t0) & (F.col("next_arrival") <= cutoff) & (F.col("next_arrival") >= F.col("departure_time"))).distinct(), "hops"
    )
    known = materialize(starts.select("stop").distinct().withColumn("arrival_time", F.lit(t0)), "known")
    front = known
    while True:
        reached = front.join(e, "stop").where("departure_time >= arrival_time").groupBy(F.col("next_stop").alias("stop")).agg(F.min("next_arrival").alias("t"))
        better = reached.join(known, "stop", "left").where("arrival_time IS NULL OR t < arrival_time").select("stop", F.col("t").alias("arrival_time"))
        front = materialize(better, "front")
        if front.isEmpty():
            discard(e)
            return known
        merged = materialize(known.join(front, "stop", "left_anti").unionByName(front), "known")
        discard(known)
        known = merged


def isochrone_walk(edges: DataFrame, places: DataFrame, starts: DataFrame, t0: int, minutes: int, walk: int = 20, speed: float = 0.6, res: int = 10) -> DataFrame:
    """(cell, value): minutes to each cell, riding and then walking. ``places``: stop, stop_lat, stop_lon.

    From a stop that is reached with some minutes left, cells within floor(least(left, walk) * speed) steps; a step costs 1 / speed minutes.
    """
    found = earliest_arrivals(edges, starts, t0, t0 + minutes * 60).withColumn("travel", F.floor((F.col("arrival_time") - t0) / 60))
    radius = F.floor(F.least(F.lit(minutes) - F.col("travel"), F.lit(walk)) * F.lit(speed)).cast("int")
    at = found.join(places, "stop").select(hex_cell(F.col("stop_lat"), F.col("stop_lon"), res).alias("cell"), "travel", radius.alias("radius"))
    spread = with_rings(at, int(walk * speed)).where(F.col("k") <= F.col("radius"))
    return spread.groupBy((F.col("cell") + F.col("delta")).alias("cell")).agg(F.min(F.col("travel") + F.col("k") / F.lit(speed)).alias("value"))


def biggest_stop(edges: DataFrame, cell: int) -> DataFrame:
    """(stop): the stop of a cell with most departures."""
    counts = edges.where(F.col("cell") == cell).groupBy("stop").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("k", F.row_number().over(W.orderBy(F.desc("n"), "stop"))).where("k = 1").select("stop")


def isochrone(edges: DataFrame, lon: float, lat: float, hours: float = 2, t0: int = 17 * 3600, res: int = 7) -> DataFrame:
    """(index, arrival_time, actual_value, value): cells reached from the biggest stop of the cell at (lon, lat).

    ``edges`` has stop, cell (of stop, at ``res``), next_stop, departure_time, next_arrival. actual_value falls from 1 to 0 over the time allowed; value is its percent
    rank (1 for a single cell), ascending. A place without stops gives its own cell with value 1 and actual_value 0.
    """
    spark = edges.sparkSession
    here = spark.range(1).select(hex_cell(F.lit(float(lat)), F.lit(float(lon)), res).alias("cell")).first()["cell"]
    start = biggest_stop(edges, here)
    if start.isEmpty():
        return spark.createDataFrame([(here, None, 0.0, 1.0)], "index long, arrival_time int, actual_value double, value double")
    found = earliest_arrivals(edges, start, t0, t0 + int(hours * 3600))
    cells = edges.groupBy("stop").agg(F.min("cell").alias("cell"))
    by_cell = found.join(cells, "stop").groupBy(F.col("cell").alias("index")).agg(F.min("arrival_time").alias("arrival_time"))
    left = F.lit(1.0) - F.floor((F.col("arrival_time") - t0) / 60) / F.lit(60.0 * hours)
    rank = F.percent_rank().over(W.orderBy("actual_value"))
    alone = F.count(F.lit(1)).over(W.partitionBy()) == 1
    out = by_cell.withColumn("actual_value", left).withColumn("value", F.when(alone, F.lit(1.0)).otherwise(rank))
    return out.orderBy("value", "index")
