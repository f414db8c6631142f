"""Distances and a hexagonal grid, as Column expressions.

The grid is one axial lattice for each resolution on an equal-area cylindrical projection that is true to shape at 45 degrees. Cell ids are the grid's
own and fit a positive long: resolution (4 bits), then q and r (29 bits each, offset). Neighbours are constant differences of ids, so a disk or a ring is
one array addition. The lattice is not closed over the 180 degree meridian, and cells stretch towards the poles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_M = 6_371_008.8
PARALLEL = math.cos(math.radians(45.0))
OFFSET = 1 << 28
#: Mean edge of resolution 0 in metres; each finer one is smaller by the square root of seven.
EDGE_0 = 1_107_712.591


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def edge_m(res: int) -> float:
    """Edge length of a cell in metres."""
    return EDGE_0 / math.sqrt(7.0) ** res


def by_resolution(res: Column, value) -> Column:
    """A constant of each resolution."""
    return F.element_at(F.array(*(F.lit(value(k)) for k in range(16))), res + 1)


def hex_cell(lat: Column, lon: Column, res: int | Column) -> Column:
    """The cell of a point; null for null coordinates."""
    per = (lambda f: F.lit(f(res))) if isinstance(res, int) else (lambda f: by_resolution(res, f))
    x = per(lambda k: RADIUS_M * PARALLEL / edge_m(k)) * F.radians(lon)
    y = per(lambda k: RADIUS_M / PARALLEL / edge_m(k)) * F.sin(F.radians(lat))
    q, r = F.lit(math.sqrt(3.0) / 3.0) * x - F.lit(1.0 / 3.0) * y, F.lit(2.0 / 3.0) * y
    s = -q - r
    near = lambda v: F.floor(v + F.lit(0.5))
    rq, rr, rs = near(q), near(r), near(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    # the coordinate that was rounded most follows from the others
    cq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    cr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return (per(lambda k: k << 58) + (cq + OFFSET) * F.lit(1 << 29) + (cr + OFFSET)).cast("long")


def hex_resolution(cell: Column) -> Column:
    return F.shiftright(cell, 58).cast("int")


def hex_q(cell: Column) -> Column:
    return F.shiftright(cell, 29).bitwiseAND(F.lit((1 << 29) - 1)) - OFFSET


def hex_r(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit((1 << 29) - 1)) - OFFSET


def hex_center(cell: Column) -> tuple[Column, Column]:
    """(lat, lon) of the middle."""
    e = by_resolution(hex_resolution(cell), edge_m)
    q, r = hex_q(cell), hex_r(cell)
    y = e * F.lit(1.5) * r
    x = e * F.lit(math.sqrt(3.0)) * (q + r / F.lit(2.0))
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y * F.lit(PARALLEL / RADIUS_M)))
    return F.degrees(F.asin(sine)), F.degrees(x * F.lit(1.0 / (RADIUS_M * PARALLEL)))


#: Degrees by which a middle is moved before it is looked up at a coarser resolution: middles may lie on borders there, where the last bit would decide.
NUDGE = (3e-9, 1e-9)


def hex_parent_at(lat: Column, lon: Column, res: int | Column) -> Column:
    """The cell of a coarser resolution that holds the middle at (lat, lon)."""
    return hex_cell(lat + F.lit(NUDGE[0]), lon + F.lit(NUDGE[1]), res)


def hex_parent(cell: Column, res: int) -> Column:
    """The cell of a coarser resolution that holds the middle."""
    return hex_parent_at(*hex_center(cell), res)


def steps(k: int, hollow: bool = False) -> list[int]:
    """Id differences of the cells within ``k`` steps, or exactly ``k`` steps away."""
    out = []
    for q in range(-k, k + 1):
        for r in range(max(-k, -q - k), min(k, -q + k) + 1):
            if not hollow or max(abs(q), abs(r), abs(q + r)) == k:
                out.append((q << 29) + r)
    return sorted(out)


def hex_disk(cell: Column, k: int) -> Column:
    """Array of the 1 + 3k(k + 1) cells within ``k`` steps."""
    return F.transform(F.array(*(F.lit(d).cast("long") for d in steps(k))), lambda d: cell + d)


def hex_ring(cell: Column, k: int) -> Column:
    """Array of the 6k cells ``k`` steps away (the cell itself for 0)."""
    return F.transform(F.array(*(F.lit(d).cast("long") for d in steps(k, hollow=True))), lambda d: cell + d)


def ring_deltas(spark, most: int):
    """(k, delta) for all rings up to ``most``: a table of 1 + 3k(k + 1) rows, to explode disks of many sizes by one join.

    Built from ranges, so that its size is known: 2,791 rows for 30 rings.
    """
    side = spark.range(-most, most + 1)
    both = side.select(F.col("id").alias("q"), F.explode(F.sequence(F.lit(-most).cast("long"), F.lit(most).cast("long"))).alias("r"))
    k = F.greatest(F.abs("q"), F.abs("r"), F.abs(F.col("q") + F.col("r"))).cast("int")
    return both.select(k.alias("k"), (F.col("q") * (1 << 29) + F.col("r")).alias("delta")).where(F.col("k") <= most)


def with_rings(df: DataFrame, most: int) -> DataFrame:
    """``df`` with k and delta of each cell within ``most`` steps: a constant array, exploded."""
    rings = ring_deltas(df.sparkSession, most).agg(F.collect_list(F.struct("k", "delta")).alias("r"))
    return df.withColumn("__r", F.explode(rings.scalar())).select("*", "__r.k", "__r.delta").drop("__r")


def hex_distance(a: Column, b: Column) -> Column:
    """Grid steps between two cells of one resolution."""
    dq, dr = hex_q(a) - hex_q(b), hex_r(a) - hex_r(b)
    return F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr))
