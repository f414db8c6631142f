"""Stops that are close to each other become one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.functions.geo import hex_cell, hex_disk
from hopline.operators.components import connected_components


def with_cell(df: DataFrame, res: int, out: str = "cell") -> DataFrame:
    return df.withColumn(out, hex_cell(F.col("stop_lat"), F.col("stop_lon"), res))


def stop_clusters(stops: DataFrame, res: int = 11, k: int = 1) -> DataFrame:
    """(cell, stop_uuid): cells of stops whose disks of ``k`` steps overlap, directly or over others, share the id of the least cell.

    Stops at (0, 0), which is where unreadable coordinates end, are left out. Cells meet under each cell of their disks, and are linked to the least that
    meets there, so no list of pairs is made; the components come from rounds on the cluster.
    """
    placed = stops.where("NOT (stop_lat = 0 AND stop_lon = 0) AND stop_lat IS NOT NULL AND stop_lon IS NOT NULL")
    cells = with_cell(placed, res).select("cell").distinct()
    reach = cells.select("cell", F.explode(hex_disk(F.col("cell"), k)).alias("near"))
    least = reach.groupBy("near").agg(F.min("cell").alias("dst"))
    edges = reach.join(least, "near").where("cell != dst").select(F.col("cell").alias("src"), "dst").distinct()
    found = connected_components(edges)
    return cells.join(found, F.col("cell") == F.col("node"), "left").select("cell", F.coalesce("component", "cell").alias("stop_uuid"))


def with_stop_uuid(day: DataFrame, clusters: DataFrame, res: int = 11) -> DataFrame:
    return with_cell(day, res).join(clusters, "cell")
