"""Pairs of places for a race by public transport."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopline.functions.aggs import distinct_on
from hopline.functions.geo import haversine_m, hex_cell, hex_center, hex_parent
from hopline.operators.clusters import with_cell
from hopline.operators.components import connected_components
from hopline.session import materialize


def mutual_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges that are also there the other way round."""
    e = edges.select(src, dst).distinct()
    back = e.select(F.col(dst).alias(src), F.col(src).alias(dst))
    return e.join(back, [src, dst], "left_semi")


def big_components(links: DataFrame, n: int = 10) -> DataFrame:
    """(cell, component) of the ``n`` components with most cells."""
    found = connected_components(links).select(F.col("node").alias("cell"), "component")
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(n)
    return found.join(sizes.select("component"), "component", "left_semi")


def cell_weights(stats: DataFrame, population: DataFrame, res: int = 6) -> DataFrame:
    """(cell, weight): how far its stops go, between 3 and 1000 km, times its people. ``population``: cell (finer), population."""
    far = with_cell(stats, res).groupBy("cell").agg(F.least(F.greatest(F.sum("crow_km"), F.lit(3.0)), F.lit(1000.0)).alias("far"))
    people = population.groupBy(hex_parent(F.col("cell"), res).alias("cell")).agg(F.sum("population").alias("pop"))
    # written, or the planner carries both long cell expressions through every filter that it infers from the join
    far, people = materialize(far, "far"), materialize(people, "people")
    return far.join(people, "cell").select("cell", (F.col("far") * F.col("pop")).alias("weight")).dropna()


def _pick(draws: DataFrame, cells: DataFrame, by: list[str], at: str, out: str) -> DataFrame:
    """``draws`` with the cell whose share of the running weights of its group holds ``at`` (0 to 1): one sort of both together, no pairs."""
    w = W.partitionBy(*by).orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    marks = cells.withColumn("pos", F.sum("weight").over(w) / F.sum("weight").over(W.partitionBy(*by)))
    marks = marks.select(*by, "pos", F.lit(1).alias("kind"), F.struct("cell", "component", "c_lat", "c_lon", "stop_lat", "stop_lon").alias(out), F.lit(None).cast(draws.select(F.struct("*")).schema[0].dataType).alias("d"))
    asked = draws.select(*by, F.col(at).alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast(marks.schema[out].dataType).alias(out), F.struct(*draws.columns).alias("d"))
    # from the far end, so that the frame grows row by row: one pass
    ahead = W.partitionBy(*by).orderBy(F.desc("pos"), F.desc("kind")).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = asked.unionByName(marks).withColumn(out, F.last(out, ignorenulls=True).over(ahead))
    return both.where(F.col("kind") == 0).where(F.col(out).isNotNull()).select("d.*", out)


def race_pairs(hops: DataFrame, stats: DataFrame, population: DataFrame, n: int = 3650, seed: int = 1, min_km: float = 100.0, res: int = 6, attempts: int = 32) -> DataFrame:
    """(draw, start_lat, start_lon, finish_lat, finish_lon): ``n`` draws of two cells of one component, each by weight, that are far enough apart.

    ``hops``: stop_lat, stop_lon, next_lat, next_lon. A draw takes the first of some finishes that is far enough away. One that finds none so draws once
    among the cells of its component that are far enough away, by weight; it is left out only where there is no such cell.
    Numbers are hashes of seed, draw and attempt, so a rerun draws the same. Cells at this resolution, which are sorted together, are bounded by the area.
    """
    there = with_cell(hops.select("stop_lat", "stop_lon", "next_lat", "next_lon"), res, "src")
    links = there.select("src", hex_cell(F.col("next_lat"), F.col("next_lon"), res).alias("dst")).where("src != dst")
    cells = big_components(mutual_edges(links)).join(cell_weights(stats, population, res), "cell").where("weight > 0")
    place = distinct_on(with_cell(hops.select("stop_lat", "stop_lon").distinct(), res), ["cell"], [F.col("stop_lat"), F.col("stop_lon")])
    lat, lon = hex_center(F.col("cell"))
    cells = materialize(cells.join(place, "cell").select("cell", "component", "weight", "stop_lat", "stop_lon", lat.alias("c_lat"), lon.alias("c_lon")), "cells")
    number = lambda *parts: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))
    draws = hops.sparkSession.range(n).select(F.col("id").alias("draw"), F.lit(0).alias("one"), number("id", F.lit(-1)).alias("x"))
    started = _pick(draws, cells.withColumn("one", F.lit(0)), ["one"], "x", "s")
    started = materialize(started, "started")
    tries = started.select("draw", "s", F.col("s.component").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("k"))
    tried = _pick(tries.withColumn("y", number("draw", "k")), cells, ["component"], "y", "f")
    far = haversine_m(F.col("s.c_lat"), F.col("s.c_lon"), F.col("f.c_lat"), F.col("f.c_lon")) > F.lit(min_km * 1000)
    best = materialize(tried.where(far).groupBy("draw").agg(F.min_by(F.struct("s", "f"), "k").alias("p")), "finishes")
    lost = materialize(started.select("draw", "s", F.col("s.component").alias("component")).join(best, "draw", "left_anti"), "lost")
    c = cells.select("component", F.struct("cell", "component", "c_lat", "c_lon", "stop_lat", "stop_lon").alias("f"), "weight", F.col("cell").alias("at"))
    there = lost.join(c, "component").where(far)  # few draws; cells are bounded by the area
    run = W.partitionBy("draw").orderBy("at")
    there = there.withColumn("upto", F.sum("weight").over(run.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("all", F.sum("weight").over(W.partitionBy("draw")))
    last = there.where(F.col("upto") > number("draw", F.lit(attempts)) * F.col("all")).groupBy("draw").agg(F.min_by(F.struct("s", "f"), "at").alias("p"))
    best = best.unionByName(last)
    ends = {f"{a}_{c}": F.col(f"p.{q}.stop_{c}") for a, q in (("start", "s"), ("finish", "f")) for c in ("lat", "lon")}
    return best.select("draw", *(c.alias(a) for a, c in ends.items()))
