"""DuckDB text for the timetable view and the hexagonal grid, from which the queries' own SQL is put together."""

from __future__ import annotations

from hopline.functions import geo
from hopline.sources.schema import WEEKDAYS


def num(x: float) -> str:
    """A double literal; without an exponent it would be a decimal."""
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


_SRC = "'f' || CAST(o_custkey % 5 AS VARCHAR)"

CTES: dict[str, str] = {
    "trips": f"SELECT {_SRC} AS source, o_orderkey AS trip_id, o_custkey AS service_id, left(o_orderpriority, 1) AS route_id, CAST(o_orderkey % 2 AS INTEGER) AS direction_id, o_orderpriority AS trip_headsign FROM orders",
    "feeds": "SELECT 'f' || CAST(i AS VARCHAR) AS source FROM range(5) t(i)",
    "routes": "SELECT source, route_id, CAST(route_type AS INTEGER) AS route_type FROM feeds, (VALUES ('1', 2), ('2', 109), ('3', 0), ('4', 3), ('5', 1100)) r(route_id, route_type)",
    "stops": "SELECT source, s_suppkey AS stop_id, s_name AS stop_name, 44e0 + CAST(s_suppkey * 37 % 100 AS DOUBLE) * 0.02e0 AS stop_lat, 2e0 + CAST(s_suppkey * 61 % 97 AS DOUBLE) * 0.03e0 AS stop_lon FROM supplier, feeds",
    "st": f"""SELECT {_SRC} AS source, l_orderkey AS trip_id, l_suppkey AS stop_id, CAST(seq AS INTEGER) AS stop_sequence,
  CAST((l_orderkey * 7 % 1080 + 300) * 60 + (seq - 1) * 900 + l_partkey % 10 * 60 AS INTEGER) AS arrival_time,
  CAST((l_orderkey * 7 % 1080 + 300) * 60 + (seq - 1) * 900 + l_partkey % 10 * 60 + l_suppkey % 3 * 60 AS INTEGER) AS departure_time
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_suppkey, l_partkey) AS seq FROM lineitem) JOIN orders ON l_orderkey = o_orderkey""",
    "day": """SELECT st.*, service_id, direction_id, trip_headsign, route_id, route_type, stop_name, stop_lat, stop_lon
FROM st JOIN trips USING (source, trip_id) JOIN routes USING (source, route_id) JOIN stops USING (source, stop_id)""",
    "cal": "SELECT 'f' || CAST(c_custkey % 5 AS VARCHAR) AS source, c_custkey AS service_id, "
    + ", ".join(f"CAST((c_custkey + {j + 1}) % 3 <> 0 AS INTEGER) AS {d}" for j, d in enumerate(WEEKDAYS))
    + ", DATE '2025-01-01' + CAST(c_custkey % 60 AS INTEGER) AS start_date, DATE '2025-01-01' + CAST(c_custkey % 60 + c_nationkey + 30 AS INTEGER) AS end_date FROM customer",
    "cd": f"SELECT DISTINCT {_SRC} AS source, o_custkey AS service_id, DATE '2025-01-01' + CAST(o_orderkey % 120 AS INTEGER) AS date, CAST(1 + o_orderkey % 2 AS INTEGER) AS exception_type FROM orders",
    "people": "SELECT 44e0 + CAST(c_custkey * 53 % 2000 AS DOUBLE) * 0.001e0 AS lat, 2e0 + CAST(c_custkey * 71 % 2910 AS DOUBLE) * 0.001e0 AS lon, CAST(floor(c_acctbal) AS BIGINT) AS population FROM customer WHERE c_acctbal > 0",
    "pat": """SELECT source, trip_id, list(stop_id ORDER BY departure_time, stop_sequence, stop_id) AS stops FROM day GROUP BY ALL""",
    "hops": """SELECT * FROM (
  SELECT *, floor(next_arrival / 60) - floor(departure_time / 60) AS travel_time FROM (
    SELECT *, coalesce(lead(stop_id) OVER w, stop_id) AS next_stop, coalesce(lead(arrival_time) OVER w, arrival_time) AS next_arrival,
      coalesce(lead(stop_lat) OVER w, stop_lat) AS next_lat, coalesce(lead(stop_lon) OVER w, stop_lon) AS next_lon
    FROM day WINDOW w AS (PARTITION BY source, trip_id ORDER BY arrival_time, stop_sequence))
) WHERE next_stop <> stop_id AND travel_time > 0""",
}
NEEDS = {"routes": ["feeds"], "stops": ["feeds"], "day": ["st", "trips", "routes", "stops"], "pat": ["day"], "hops": ["day"]}


def view(*names: str, **more: str) -> str:
    """``WITH`` the named parts of the view, all that they need, and further ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ", ".join([f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({s})" for n, s in more.items()]) + " "


def cells(src: str, res: int, lat: str = "stop_lat", lon: str = "stop_lon", out: str = "cell") -> str:
    """``src`` with the cell of a point."""
    import math

    e = geo.edge_m(res)
    x, y = f"{num(geo.RADIUS_M * geo.PARALLEL / e)} * radians({lon})", f"{num(geo.RADIUS_M / geo.PARALLEL / e)} * sin(radians({lat}))"
    return f"""(SELECT * EXCLUDE (hq, hr, rq, rr, rs), CAST({res << 58} + (CASE WHEN abs(rq - hq) > abs(rr - hr) AND abs(rq - hq) > abs(rs + hq + hr) THEN -rr - rs ELSE rq END::BIGINT + {geo.OFFSET}) * {1 << 29}
  + (CASE WHEN abs(rq - hq) > abs(rr - hr) AND abs(rq - hq) > abs(rs + hq + hr) THEN rr WHEN abs(rr - hr) > abs(rs + hq + hr) THEN -rq - rs ELSE rr END::BIGINT + {geo.OFFSET}) AS BIGINT) AS {out}
FROM (SELECT *, floor(hq + 0.5e0) AS rq, floor(hr + 0.5e0) AS rr, floor(-hq - hr + 0.5e0) AS rs FROM (
  SELECT *, {num(math.sqrt(3.0) / 3.0)} * ({x}) - {num(1.0 / 3.0)} * ({y}) AS hq, {num(2.0 / 3.0)} * ({y}) AS hr FROM {src})))"""


def center(cell: str) -> tuple[str, str]:
    """(lat, lon) of a cell's middle."""
    import math

    e = "list_extract([" + ", ".join(num(geo.edge_m(k)) for k in range(16)) + f"], CAST({cell} >> 58 AS INTEGER) + 1)"
    q, r = f"((({cell} >> 29) & {(1 << 29) - 1}) - {geo.OFFSET})", f"(({cell} & {(1 << 29) - 1}) - {geo.OFFSET})"
    lat = f"degrees(asin(greatest(-1e0, least(1e0, {e} * 1.5e0 * {r} * {num(geo.PARALLEL / geo.RADIUS_M)}))))"
    lon = f"degrees({e} * {num(math.sqrt(3.0))} * ({q} + {r} / 2e0) * {num(1.0 / (geo.RADIUS_M * geo.PARALLEL))})"
    return lat, lon


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"({num(2 * geo.RADIUS_M)} * asin(sqrt(least(1e0, {a}))))"


def rings(most: int) -> str:
    """(k, delta) of all cells within ``most`` steps."""
    return f"SELECT greatest(abs(q), abs(r), abs(q + r)) AS k, q * {1 << 29} + r AS delta FROM range(-{most}, {most + 1}) a(q), range(-{most}, {most + 1}) b(r) WHERE greatest(abs(q), abs(r), abs(q + r)) <= {most}"
