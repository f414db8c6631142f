"""Queries over the timetable view of the driver tables, each with its DuckDB counterpart where SQL can say it.

Doubles are rounded to six decimals on both sides; tests of the operators look at them unrounded.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopline.functions import aggs
from hopline.functions.geo import edge_m, hex_cell, hex_center, hex_disk, hex_distance
from hopline.functions.timefn import timestamp_minutes_between
from hopline.operators import access, clusters, edges, facts, race, routing, service, stats
from hopline.plans.oracle import cells, center, haversine, num, rings, view
from hopline.plans.view import Timetable
from hopline.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
D0, D1 = dt.date(2025, 1, 15), dt.date(2025, 3, 15)


def query(name: str, sql: str | None = None):
    """Register a query; its doubles are rounded."""

    def add(f: Callable[[Timetable], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Timetable(spark, sf_dir))
            return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add


def spread(df: DataFrame, col: str, names: list[str]) -> DataFrame:
    return df.select(*(c for c in df.columns if c != col), *(F.col(col)[i].alias(n) for i, n in enumerate(names)))


# --- services, trips, the day ---------------------------------------------------------------------------------------------------------------

_DAYS = "SELECT CAST(DATE '2025-01-15' + CAST(i AS INTEGER) AS DATE) AS d FROM range(60) t(i)"
_FLAG = " OR ".join(f"(isodow(d) = {i + 1} AND {w} = 1)" for i, w in enumerate(["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]))
_ACTIVE = f"""SELECT source, service_id, d AS check_date FROM cal JOIN days ON d BETWEEN start_date AND end_date
  WHERE ({_FLAG}) AND NOT EXISTS (SELECT 1 FROM cd WHERE cd.source = cal.source AND cd.service_id = cal.service_id AND cd.date = d AND exception_type = 2)
  UNION SELECT source, service_id, date FROM cd WHERE exception_type = 1 AND date BETWEEN DATE '2025-01-15' AND DATE '2025-03-15'"""
_BEST = "SELECT source, check_date AS best_date, n AS num_active_services FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, check_date) AS k FROM (SELECT source, check_date, count(*) AS n FROM active GROUP BY ALL)) WHERE k = 1"
_SERVICE = {"days": _DAYS, "active": _ACTIVE}


def _active(t: Timetable) -> DataFrame:
    return service.active_services(t.calendar(), t.calendar_dates(), D0, D1)


@query("x01_active_services", view("cal", "cd", **_SERVICE) + "SELECT * FROM active")
def x01(t):
    return _active(t)


@query("x02_best_day", view("cal", "cd", **_SERVICE) + _BEST)
def x02(t):
    return service.best_day(_active(t))


@query(
    "x03_valid_trips",
    view("cal", "cd", "trips", **_SERVICE, best=_BEST)
    + "SELECT DISTINCT source, trip_id FROM trips WHERE (source, service_id) IN (SELECT (a.source, service_id) FROM active a JOIN best b ON a.source = b.source AND a.check_date = b.best_date)",
)
def x03(t):
    active = _active(t)
    return service.valid_trips(t.trips(), active, service.best_day(active))


@query("x03b_services_on", view("cal", "cd", **_SERVICE) + "SELECT source, service_id FROM active WHERE check_date = DATE '2025-02-04'")
def x03b(t):
    return service.services_on(t.calendar(), t.calendar_dates(), dt.date(2025, 2, 4))


@query("x04_one_day", view("day") + "SELECT * REPLACE (round(stop_lat, 6) AS stop_lat, round(stop_lon, 6) AS stop_lon) FROM day")
def x04(t):
    return t.day()


@query("x05_patterns", view("pat") + "SELECT source, CAST(len(stops) AS INTEGER) AS n_stops, count(*) AS trips FROM pat GROUP BY source, stops")
def x05(t):
    return facts.stopping_patterns(t.day()).groupBy("source", "sane_route_id", "n_stops").agg(F.count(F.lit(1)).alias("trips")).drop("sane_route_id")


@query(
    "x06_clusters",
    view("stops")
    + f""", c AS (SELECT DISTINCT cell FROM {cells("stops", 8)}), d AS ({rings(1)}), e AS (
  SELECT DISTINCT a.cell AS u, b.cell AS v FROM (SELECT cell, cell + delta AS n FROM c, d) a JOIN (SELECT cell, cell + delta AS n FROM c, d) b USING (n)
), r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT u AS cell, min(v) AS stop_uuid FROM r GROUP BY u""",
)
def x06(t):
    return clusters.stop_clusters(t.stops(), res=8)


# --- edges ----------------------------------------------------------------------------------------------------------------------------------

_POP = f"SELECT cell, CAST(sum(population) AS BIGINT) AS population FROM {cells('people', 9, 'lat', 'lon')} GROUP BY cell"
_HC = f"SELECT * FROM {cells('(SELECT * FROM ' + cells('hops', 9, out='c') + ')', 9, 'next_lat', 'next_lon', 'nc')}"
_EDGE = {
    "pop": _POP,
    "ring": rings(4),
    "hc": _HC,
    "pairs": "SELECT DISTINCT c, nc FROM hc",
    "gone": "SELECT c, nc, c + delta AS cell FROM pairs, ring WHERE NOT EXISTS (SELECT 1 FROM ring r2 WHERE nc + r2.delta = c + ring.delta)",
    "ppl": "SELECT c, nc, CAST(sum(population) AS BIGINT) AS next_pop FROM gone JOIN pop USING (cell) GROUP BY c, nc",
    "edges": "SELECT source, trip_id, stop_id, stop_sequence, stop_lat, stop_lon, departure_time, next_stop, next_arrival, CAST(travel_time AS INTEGER) AS travel_time, route_type, next_pop, next_pop / travel_time AS pop_per_minute FROM hc JOIN ppl USING (c, nc)",
}
_R6 = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("x07_edgelist", view("hops", "people", **_EDGE) + f"SELECT * REPLACE ({_R6('stop_lat', 'stop_lon', 'pop_per_minute')}) FROM edges")
def x07(t):
    return t.edges()


@query(
    "x08_edges_ext",
    view("hops")
    + f""", ends AS (SELECT source, trip_id, arg_min(stop_id, (arrival_time, stop_sequence)) AS initial_stop, min(arrival_time) AS initial_arrival, arg_min(stop_name, (arrival_time, stop_sequence)) AS initial_name,
  arg_max(stop_id, (arrival_time, stop_sequence)) AS final_stop, max(arrival_time) AS final_arrival, arg_max(stop_name, (arrival_time, stop_sequence)) AS final_name FROM day GROUP BY ALL),
hx AS (SELECT * FROM {cells("(SELECT * FROM " + cells("hops", 11) + ")", 11, "next_lat", "next_lon", "next_cell")})
SELECT source, trip_id, stop_id, stop_sequence, cell, next_cell, departure_time, next_stop, next_arrival, {_R6("next_lat", "next_lon")}, final_stop, final_arrival, final_name, initial_stop, initial_arrival,
  initial_name, CAST(travel_time AS INTEGER) AS travel_time, route_type, stop_name FROM hx JOIN ends USING (source, trip_id)""",
)
def x08(t):
    cols = "source trip_id stop_id stop_sequence cell next_cell departure_time next_stop next_arrival next_lat next_lon final_stop final_arrival final_name initial_stop initial_arrival initial_name travel_time route_type stop_name"
    return edges.edge_list_ext(t.day()).select(*cols.split())


@query("x32_edge_export", view("hops") + f"SELECT stop_id, cell, next_stop, departure_time, next_arrival FROM {cells('hops', 7)}")
def x32(t):
    return edges.edge_export(t.hops(), stop="stop_id")


# --- routing --------------------------------------------------------------------------------------------------------------------------------

_T0, _CUT = 9 * 3600, 13 * 3600
_ARR = f"""SELECT stop, min(t) AS arrival_time FROM r GROUP BY stop"""
_R = f"""SELECT CAST(1 AS BIGINT) AS stop, {_T0} AS t UNION SELECT h.next_stop, h.next_arrival FROM r JOIN hops h ON r.stop = h.stop_id
  WHERE h.source = 'f0' AND h.departure_time >= r.t AND h.next_arrival <= {_CUT}"""


def _stop_key(stop: str):
    """Stop ids are unique only within a feed."""
    return F.concat_ws(":", "source", stop)


def _hops_of(t: Timetable) -> DataFrame:
    return t.hops().withColumn("stop", _stop_key("stop_id")).withColumn("next_stop", _stop_key("next_stop"))


def _first_stop(t: Timetable) -> DataFrame:
    return t.spark.range(1).select(F.lit("f0:1").alias("stop"))


@query("x09_earliest_arrival", view("hops", **{"r(stop, t)": _R}) + _ARR)
def x09(t):
    # no hop leaves its feed, so all stops found are of the first one's
    found = routing.earliest_arrivals(_hops_of(t), _first_stop(t), _T0, _CUT)
    return found.select(F.substring_index("stop", ":", -1).cast("long").alias("stop"), "arrival_time")


@query(
    "x09b_isochrone_walk",
    view("hops", **{"r(stop, t)": _R.replace(str(_CUT), str(_T0 + 7200))})
    + f""", a AS (SELECT stop, floor((min(t) - {_T0}) / 60) AS travel FROM r GROUP BY stop), p AS (SELECT * FROM {cells("stops", 10)} WHERE source = 'f0'), ring AS ({rings(12)}),
x AS (SELECT cell, travel, floor(least(120 - travel, 20) * 0.6e0) AS radius FROM a JOIN p ON a.stop = p.stop_id)
SELECT CAST(cell + delta AS BIGINT) AS cell, round(min(travel + k / 0.6e0), 6) AS value FROM x JOIN ring ON k <= radius GROUP BY ALL""",
)
def x09b(t):
    places = t.stops().withColumn("stop", _stop_key("stop_id"))
    return routing.isochrone_walk(_hops_of(t), places, _first_stop(t), _T0, 120)


_X10 = {
    "e": f"SELECT * FROM {cells('hops', 7)}",
    "home": f"SELECT cell AS here FROM {cells('(SELECT * FROM stops WHERE source = ' + chr(39) + 'f0' + chr(39) + ' AND stop_id = 1)', 7)}",
    "s0": "SELECT source, stop_id FROM (SELECT source, stop_id, count(*) AS n FROM e WHERE cell = (SELECT here FROM home) GROUP BY ALL) ORDER BY n DESC, source || ':' || stop_id LIMIT 1",
    "r(source, stop, t)": "SELECT source, stop_id, 32400 FROM s0 UNION SELECT h.source, h.next_stop, h.next_arrival FROM r JOIN hops h ON r.source = h.source AND r.stop = h.stop_id WHERE h.departure_time >= r.t AND h.next_arrival <= 54000",
    "a": "SELECT source, stop, min(t) AS t FROM r GROUP BY ALL",
    "c": "SELECT source, stop_id AS stop, min(cell) AS cell FROM e GROUP BY ALL",
    "b": "SELECT cell AS index, CAST(min(t) AS INTEGER) AS arrival_time FROM a JOIN c USING (source, stop) GROUP BY cell",
    "v": "SELECT *, 1e0 - floor((arrival_time - 32400) / 60) / 360e0 AS actual_value FROM b",
}


@query(
    "x10_isochrone",
    view("hops", **_X10) + "SELECT index, arrival_time, round(actual_value, 6) AS actual_value, round(CASE WHEN count(*) OVER () = 1 THEN 1e0 ELSE percent_rank() OVER (ORDER BY actual_value) END, 6) AS value FROM v",
)
def x10(t):
    e = _hops_of(t).withColumn("cell", hex_cell(F.col("stop_lat"), F.col("stop_lon"), 7))
    here = t.stops().where("stop_id = 1").first()
    return routing.isochrone(e, here["stop_lon"] if here else 0.0, here["stop_lat"] if here else 0.0, hours=6, t0=9 * 3600)


# --- access ---------------------------------------------------------------------------------------------------------------------------------

_E10 = num(edge_m(10))
_POP60 = _EDGE | {
    "tv": "SELECT source, trip_id, sum(next_pop) / (sum(travel_time) + count(*) * 5) AS value FROM edges GROUP BY ALL",
    "sr": "SELECT *, 1080e0 / (departs * 2) AS wait FROM (SELECT source, stop_id, stop_lat, stop_lon, avg(value) AS ppm, count(*) AS departs FROM edges JOIN tv USING (source, trip_id) GROUP BY ALL)",
    "sc": f"SELECT cell, ppm, wait, greatest(0e0, (55e0 - wait) * ppm) AS reach FROM {cells('sr', 10)} WHERE wait <= 55",
    "bc": "SELECT cell, arg_max(ppm, (reach, ppm, -wait)) AS ppm, arg_max(wait, (reach, ppm, -wait)) AS wait FROM sc GROUP BY cell",
    "r30": rings(30),
    "pop60": f"SELECT * FROM (SELECT CAST(cell + delta AS BIGINT) AS cell, max((55e0 - (k * 2 + 1) * {_E10} / 40e0 - wait) * ppm) AS pop_in_60 FROM bc, r30 GROUP BY ALL) WHERE pop_in_60 > 0",
}
_LAT, _LON = center("cell")


def _pop60(t: Timetable) -> DataFrame:
    return access.pop_within_60(t.edges())


@query("x11_pop60", view("hops", "people", **_POP60) + f"SELECT round({_LON}, 6) AS lon, round({_LAT}, 6) AS lat, round(pop_in_60, 6) AS pop_in_60, cell FROM pop60")
def x11(t):
    return _pop60(t)


@query(
    "x12_bake",
    view("hops", "people", **_POP60)
    + f""", pc AS (SELECT {_LON} AS lon, {_LAT} AS lat, pop_in_60 FROM pop60), up AS ("""
    + " UNION ALL ".join(f"SELECT lon, lat, pop_in_60, cell, {r} AS res FROM {cells('pc', r, '(lat + 3e-9)', '(lon + 1e-9)')}" for r in range(4, 10))
    + """) SELECT cell, res, round(avg(lon), 4) AS lon, round(avg(lat), 4) AS lat, round(median(pop_in_60), 4) AS pop_in_60 FROM up GROUP BY cell, res
  UNION ALL SELECT cell, 10, round(" + _LON + ", 4), round(" + _LAT + ", 4), round(pop_in_60, 4) FROM pop60""".replace('" + _LON + "', _LON).replace('" + _LAT + "', _LAT),
)
def x12(t):
    pop = _pop60(t)
    # four decimals: the order in which floats are added shows in the sixth
    return access.bake(pop).withColumns({c: F.round(c, 4) for c in ("lon", "lat", "pop_in_60")})


_T2T = {
    "calls": "SELECT source, stop_id, stop_lat, stop_lon, count(*) AS n FROM day GROUP BY ALL",
    "most": f"SELECT cell, max(n) AS n FROM {cells('calls', 10)} GROUP BY cell",
    "r30": rings(30),
    "t2t": f"SELECT * FROM (SELECT CAST(cell + delta AS BIGINT) AS cell, min(1080e0 / (n * 2) + (k * 2 + 1) * {_E10} / 40e0) AS time_to_transport FROM most, r30 GROUP BY ALL) WHERE time_to_transport <= 60",
    "inh": f"SELECT DISTINCT cell FROM {cells('people', 10, 'lat', 'lon')}",
}


@query("x25_time_to_transport", view("day", "people", **_T2T) + "SELECT cell, round(time_to_transport, 6) AS time_to_transport FROM t2t WHERE cell IN (SELECT cell FROM inh)")
def x25(t):
    return access.time_to_transport(t.day(), t.inhabited())


_MID_LAT, _MID_LON = center("cell")


@query(
    "x25b_coarse",
    view("day", "people", **_T2T, pop=_POP)
    + f""", m1 AS (SELECT {_MID_LAT} AS clat, {_MID_LON} AS clon, time_to_transport FROM t2t), mid AS (SELECT cell, median(time_to_transport) AS t FROM {cells("m1", 9, "(clat + 3e-9)", "(clon + 1e-9)")} GROUP BY cell),
b0 AS (SELECT {_MID_LAT} AS clat, {_MID_LON} AS clon, coalesce(t, 60e0) AS t, population FROM pop LEFT JOIN mid USING (cell)), b AS (SELECT cell, t, sum(population) AS w FROM {cells("b0", 2, "(clat + 3e-9)", "(clon + 1e-9)")} GROUP BY cell, t),
c AS (SELECT *, sum(w) OVER (PARTITION BY cell ORDER BY t) AS run, sum(w) OVER (PARTITION BY cell) AS total FROM b)
SELECT cell, round(min(t), 6) AS value FROM c WHERE 2 * run >= total GROUP BY cell""",
)
def x25b(t):
    return access.time_to_transport_coarse(access.time_to_transport(t.day()), t.population())


@query(
    "x26_velocity",
    view("hops", "people", **_EDGE)
    + ", tv AS (SELECT source, trip_id, sum(next_pop) / sum(travel_time) AS v FROM edges GROUP BY ALL) SELECT source, stop_id, round(avg(v), 6) AS value FROM edges JOIN tv USING (source, trip_id) GROUP BY ALL",
)
def x26(t):
    return access.velocity(t.edges(), ["source", "stop_id"])


@query(
    "x27_uninhabited",
    view("hops", "people", **_POP60, inh=_T2T["inh"]) + "SELECT cell, round(pop_in_60, 6) AS value FROM pop60 WHERE pop_in_60 > 2000 AND cell NOT IN (SELECT cell FROM inh)",
)
def x27(t):
    return access.uninhabited(_pop60(t), t.inhabited(), min_pop=2000.0)


# --- stops and routes -----------------------------------------------------------------------------------------------------------------------

_RANK = (
    "CASE "
    + " ".join(
        f"WHEN {' OR '.join(([f'route_type IN ({", ".join(map(str, codes))})'] if codes else []) + [f'route_type BETWEEN {a} AND {b}' for a, b in spans])} THEN {rank}" for rank, codes, spans in stats.PRIORITY
    )
    + " ELSE 999 END"
)
_PD = "SELECT day.*, stops AS pattern FROM day JOIN pat USING (source, trip_id)"
_BOX = f"SELECT source, pattern, {haversine('max(stop_lat)', 'max(stop_lon)', 'min(stop_lat)', 'min(stop_lon)')} / 1000e0 AS crow_km FROM pd GROUP BY source, pattern"
_REP = f"""SELECT KEYS, arg_min((stop_lat, stop_lon, stop_name, route_type), (rank, -n, (stop_lat, stop_lon, stop_name, route_type))) AS b
  FROM (SELECT KEYS, stop_lat, stop_lon, stop_name, route_type, {_RANK} AS rank, count(*) AS n FROM pd GROUP BY ALL) GROUP BY ALL"""
_SHOW = "round(b[1], 6) AS stop_lat, round(b[2], 6) AS stop_lon, b[3] AS stop_name, b[4] AS route_type"


def _pattern_day(t: Timetable) -> DataFrame:
    # not a plain alias: with two names for one column the planner infers ever more filters
    return t.patterned().withColumn("stop_uuid", F.col("stop_id") + F.lit(0))


@query(
    "x13_stop_stats",
    view("pat", pd=_PD, box=_BOX, rep=_REP.replace("KEYS", "stop_id"))
    + f", reach AS (SELECT stop_id, max(crow_km) AS crow_km FROM (SELECT DISTINCT source, pattern, stop_id FROM pd) JOIN box USING (source, pattern) GROUP BY stop_id) SELECT round(crow_km, 6) AS crow_km, stop_id AS stop_uuid, {_SHOW} FROM reach JOIN rep USING (stop_id)",
)
def x13(t):
    return stats.stop_statistics(_pattern_day(t))


@query(
    "x13b_stop_stats_unmerged",
    view("pat", pd=_PD, box=_BOX, rep=_REP.replace("KEYS", "stop_id, source"))
    + f", reach AS (SELECT stop_id, source, max(crow_km) AS crow_km FROM (SELECT DISTINCT source, pattern, stop_id FROM pd) JOIN box USING (source, pattern) GROUP BY stop_id, source) SELECT round(crow_km, 6) AS crow_km, stop_id, source, stop_id AS stop_uuid, {_SHOW} FROM reach JOIN rep USING (stop_id, source)",
)
def x13b(t):
    return stats.stop_statistics(_pattern_day(t), merged=False)


@query(
    "x13c_stop_stats_terminal",
    view("pat", pd=_PD, rep=_REP.replace("KEYS", "stop_id, source"))
    + f""", term AS (SELECT source, pattern, arg_max((stop_lat, stop_lon), (arrival_time, stop_id)) AS t FROM pd GROUP BY ALL),
reach AS (SELECT stop_id, source, max({haversine("stop_lat", "stop_lon", "t[1]", "t[2]")} / 1000e0) AS crow_km FROM pd JOIN term USING (source, pattern) GROUP BY stop_id, source)
SELECT round(crow_km, 6) AS crow_km, stop_id, source, stop_id AS stop_uuid, {_SHOW} FROM reach JOIN rep USING (stop_id, source)""",
)
def x13c(t):
    return stats.stop_statistics(_pattern_day(t), merged=False, to_terminal=True)


@query(
    "x14_utilisation_quartiles",
    """SELECT event_type, round(quantile_cont(share, 0.25), 6) AS q25, round(quantile_cont(share, 0.5), 6) AS q50, round(quantile_cont(share, 0.75), 6) AS q75 FROM (
  SELECT event_type, c / max(c) OVER (PARTITION BY event_type) AS share FROM (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS c FROM events GROUP BY ALL)) GROUP BY event_type""",
)
def x14(t):
    return spread(stats.utilisation_quartiles(t.raw("events"), "event_type", "ts"), "q", ["q25", "q50", "q75"])


_PROBE = """WITHS, spans AS (SELECT KEYS, trip_id, min(departure_time) AS a, max(arrival_time) AS b FROM BASE GROUP BY ALL),
i AS (SELECT KEYS, a, least(b, 86399) AS b FROM spans WHERE a < 86400 UNION ALL SELECT KEYS, greatest(a - 86400, 0), b - 86400 FROM spans WHERE b >= 86400),
probes AS (SELECT CAST(p * 300 AS INTEGER) AS probe FROM range(288) t(p)),
cnt AS (SELECT KEYS, probe, count(*) AS c FROM i JOIN probes ON probe BETWEEN a AND b GROUP BY ALL),
act AS (SELECT KEYS, probe, coalesce(c, 0) AS c FROM (SELECT * FROM (SELECT DISTINCT KEYS FROM BASE) CROSS JOIN probes) LEFT JOIN cnt USING (KEYS, probe)) """


def _probes(withs: str, keys: str, base: str) -> str:
    return _PROBE.replace("WITHS", withs.rstrip()).replace("KEYS", keys).replace("BASE", base)


@query("x15_active_probes", _probes(view("st"), "source", "st") + "SELECT * FROM act")
def x15(t):
    return stats.active_probes(t.stop_times(), ["source"])


@query(
    "x15b_active_trains_share",
    _probes(view("day", trains="SELECT * FROM day WHERE route_type = 2 OR route_type BETWEEN 100 AND 199"), "source", "trains") + "SELECT source, probe, round(c / max(c) OVER (PARTITION BY source), 6) AS share FROM act",
)
def x15b(t):
    trains = t.day().where(stats.is_train(F.col("route_type")))
    return aggs.normalised(stats.active_probes(trains, ["source"]), ["source"], "c").drop("c")


@query(
    "x15c_active_patterns",
    _probes(view("pat", pd=_PD), "source, pattern", "pd") + "SELECT left(source, 2) AS country, probe, round(avg(CASE WHEN c > 0 THEN 1e0 ELSE 0e0 END), 6) AS active_routes FROM act GROUP BY ALL",
)
def x15c(t):
    return stats.active_patterns(t.patterned())


_HEAD = """SELECT *, floor(departure_time / 60) - floor(prev_departure / 60) AS headway FROM (
  SELECT *, lag(departure_time) OVER w AS prev_departure, lag(trip_id) OVER w AS prev_trip FROM day WINDOW w AS (PARTITION BY source, stop_id, route_id, direction_id ORDER BY departure_time, trip_id, stop_sequence))"""
_HEADKEYS = ["source", "stop_id", "route_id", "direction_id"]


@query("x16_headway_hist", view("day", head=_HEAD) + "SELECT source, CAST(headway AS INTEGER) AS headway, count(*) AS n FROM head WHERE headway BETWEEN 1 AND 120 GROUP BY ALL")
def x16(t):
    return stats.headway_histogram(t.day(), _HEADKEYS)


@query(
    "x16b_headways_context",
    view("day", head=_HEAD) + "SELECT source, stop_name, stop_id, route_id, departure_time, prev_departure, CAST(headway AS INTEGER) AS headway, prev_trip, trip_id, direction_id FROM head WHERE headway BETWEEN 1 AND 5",
)
def x16b(t):
    return stats.headways(t.day(), _HEADKEYS, 1, 5).select("source", "stop_name", "stop_id", "route_id", "departure_time", "prev_departure", "headway", "prev_trip", "trip_id", "direction_id")


def _takt(hit: str, by: str = "source", src: str = "head") -> str:
    return f"SELECT {by}, round(avg(CASE WHEN {hit} THEN 1e0 ELSE 0e0 END), 6) AS value FROM {src} WHERE headway BETWEEN 10 AND 300 GROUP BY {by}"


def _heads(t: Timetable) -> DataFrame:
    return stats.headways(t.day(), _HEADKEYS, 10, 300)


@query("x17_takt_strict", view("day", head=_HEAD) + _takt("60 % headway = 0 OR headway = 120"))
def x17s(t):
    return stats.takt_score(_heads(t), ["source"], "strict")


@query("x17_takt_lenient", view("day", head=_HEAD) + _takt("least(60 % headway, headway - 60 % headway) <= 5"))
def x17l(t):
    return stats.takt_score(_heads(t), ["source"], "lenient")


_NEAR = " OR ".join(f"abs(headway - {x}) <= 0.05e0 * greatest(headway, {x})" for x in stats.TAKTS)


@query(
    "x17_takt_weighted",
    view("day", head=_HEAD) + f", g AS (SELECT source, headway, count(*) AS n FROM head WHERE headway BETWEEN 10 AND 300 GROUP BY ALL) SELECT source, round(sum(CASE WHEN {_NEAR} THEN n ELSE 0 END) / sum(n), 6) AS value FROM g GROUP BY source",
)
def x17w(t):
    hist = stats.headway_histogram(t.day(), _HEADKEYS, low=10, high=300)
    return stats.takt_score(hist, ["source"], "weighted", weight="n")


@query("x17_takt_per_cell", view("day", head=_HEAD) + _takt("60 % headway = 0 OR headway = 120", "cell", cells("head", 5)))
def x17c(t):
    return stats.takt_score(_heads(t).withColumn("cell", hex_cell(F.col("stop_lat"), F.col("stop_lon"), 5)), ["cell"])


_LEGS = f"""SELECT m.*, {haversine("a.stop_lat", "a.stop_lon", "b.stop_lat", "b.stop_lon")} AS metres, floor(departure_time / 60) - floor(prev_departure / 60) AS minutes FROM (
  SELECT *, lag(stop_id) OVER w AS prev_stop, lag(departure_time) OVER w AS prev_departure FROM st WINDOW w AS (PARTITION BY source, trip_id ORDER BY departure_time, stop_sequence)) m
JOIN stops a ON m.source = a.source AND m.prev_stop = a.stop_id JOIN stops b ON m.source = b.source AND m.stop_id = b.stop_id"""


@query(
    "x18_speed_hist",
    view("st", "stops", legs=_LEGS) + "SELECT source, speed, count(*) AS c FROM (SELECT source, round((metres / 1000e0) / nullif(minutes / 60e0, 0), -1) + 0e0 AS speed FROM legs) WHERE speed BETWEEN 0 AND 400 GROUP BY ALL",
)
def x18(t):
    return stats.speed_histogram(t.stop_times(), t.stops())


@query(
    "x19_dwell",
    view("st") + "SELECT source, CAST(d AS INTEGER) AS dwell_time, count(*) AS c FROM (SELECT source, floor(departure_time / 60) - floor(arrival_time / 60) AS d FROM st) WHERE d > 0 GROUP BY ALL",
)
def x19(t):
    return stats.dwell_histogram(t.stop_times())


@query(
    "x19b_dwell_share",
    view("st")
    + """, g AS (SELECT source, trip_id, sum(CASE WHEN d < 20 THEN d ELSE 0 END) AS d, floor(max(arrival_time) / 60) - floor(min(departure_time) / 60) AS t
  FROM (SELECT *, floor(departure_time / 60) - floor(arrival_time / 60) AS d FROM st) GROUP BY ALL)
SELECT source, round(d / nullif(t, 0), 2) + 0e0 AS dwell_percent, count(*) AS c FROM g WHERE t <> 0 GROUP BY ALL""",
)
def x19b(t):
    return stats.dwell_share(t.stop_times())


_TRIPLIST = {
    "legs": _LEGS,
    "dist": "SELECT source, trip_id, round(sum(metres) / 1000e0, 3) AS total_dist FROM legs GROUP BY ALL",
    "ends": "SELECT source, trip_id, min(departure_time) AS dt, max(arrival_time) AS \"at\", arg_min(stop_id, (departure_time, stop_sequence)) AS a, arg_max(stop_id, (departure_time, stop_sequence)) AS b FROM st GROUP BY ALL",
    "tl": """SELECT source, trip_id, dt, "at", CAST(total_t AS INTEGER) AS total_t, x.stop_name AS start_stop, y.stop_name AS end_stop, total_dist FROM (
  SELECT *, row_number() OVER (PARTITION BY source, total_dist, total_t ORDER BY trip_id) AS k FROM (SELECT *, floor("at" / 60) - floor(dt / 60) AS total_t FROM ends JOIN dist USING (source, trip_id))) q
JOIN (SELECT source, stop_id AS a, stop_name FROM stops) x USING (source, a) JOIN (SELECT source, stop_id AS b, stop_name FROM stops) y USING (source, b) WHERE k = 1""",
}


@query("x20_trip_list", view("st", "stops", **_TRIPLIST) + "SELECT * FROM tl")
def x20(t):
    return stats.trip_list(t.stop_times(), t.stops())


@query(
    "x21_best_od",
    view("st", "stops", **_TRIPLIST)
    + """, best AS (SELECT source, start_stop, end_stop, max(speed) AS speed, median(total_dist) AS total_dist, min(total_t) AS total_t FROM (SELECT *, total_dist / (total_t / 60e0) AS speed FROM tl WHERE total_t <> 0) GROUP BY ALL),
q AS (SELECT *, cume_dist() OVER (PARTITION BY source ORDER BY speed) AS cd, speed * total_t AS d FROM best)
SELECT source, start_stop, end_stop, round(speed, 6) AS speed, round(total_dist, 6) AS total_dist, total_t,
  round(CASE WHEN max(cd) OVER s > min(cd) OVER s THEN (cd - min(cd) OVER s) / (max(cd) OVER s - min(cd) OVER s) ELSE 1e0 END, 6) AS speed_quantile,
  round(sum(d) OVER (PARTITION BY source ORDER BY speed, start_stop, end_stop ROWS UNBOUNDED PRECEDING) / sum(d) OVER s, 6) AS dist_share FROM q WINDOW s AS (PARTITION BY source)""",
)
def x21(t):
    return stats.best_od(stats.trip_list(t.stop_times(), t.stops()))


@query("x22_calls_per_cell", view("day") + f"SELECT cell, count(*) AS value FROM {cells('day', 7)} GROUP BY cell")
def x22(t):
    return stats.calls_per_cell(t.day(), 7)


@query(
    "x22b_heavy_route_type",
    view("day") + f"SELECT cell, arg_min(route_type, (-n, route_type)) AS value FROM (SELECT cell, route_type, count(*) AS n FROM {cells('day', 6)} GROUP BY ALL) GROUP BY cell",
)
def x22b(t):
    return stats.heavy_route_type(t.day(), 6)


@query(
    "x23_bedtime",
    view("day")
    + f""", p AS (SELECT cell, h, count(*) AS c FROM {cells("day", 5)}, (SELECT CAST(h AS INTEGER) AS h FROM range(48) t(h)) WHERE departure_time BETWEEN h * 3600 AND h * 3600 + 3600 GROUP BY ALL),
s AS (SELECT *, c / max(c) OVER (PARTITION BY cell) AS share FROM p) SELECT cell, min(h) * 3600 AS bedtime FROM s WHERE h >= 17 AND share > 0 AND share <= 0.5e0 GROUP BY cell""",
)
def x23(t):
    return stats.bedtime(t.day())


@query(
    "x24_lunch",
    view("day")
    + f""", p AS (SELECT cell, h, count(*) AS c FROM {cells("day", 8)}, range(25) t(h) WHERE arrival_time < 86400 AND floor(arrival_time / 60) BETWEEN h * 60 - 59 AND h * 60 GROUP BY ALL),
s AS (SELECT *, c / max(c) OVER (PARTITION BY cell) AS value FROM p) SELECT cell, round(value, 6) AS value FROM s WHERE h = 12""",
)
def x24(t):
    return stats.lunch(t.day())


@query(
    "x28_overnight",
    view("hops")
    + """, g AS (SELECT source, trip_id, arg_min(stop_id, (departure_time, stop_sequence)) AS departure, min(departure_time) AS departure_t, arg_max(next_stop, (next_arrival, stop_sequence)) AS arrival, max(next_arrival) AS arrival_t
  FROM hops WHERE route_type = 2 OR route_type BETWEEN 100 AND 199 GROUP BY ALL) SELECT * FROM g WHERE floor(departure_t / 86400) < floor(arrival_t / 86400) ORDER BY arrival_t DESC, source, trip_id LIMIT 100""",
)
def x28(t):
    return stats.overnight(t.hops())


_SEG = f"""SELECT CASE WHEN (stop_lat, stop_lon) < (next_lat, next_lon) THEN (stop_lat, stop_lon) ELSE (next_lat, next_lon) END AS a,
  CASE WHEN (stop_lat, stop_lon) < (next_lat, next_lon) THEN (next_lat, next_lon) ELSE (stop_lat, stop_lon) END AS b,
  {haversine("stop_lat", "stop_lon", "next_lat", "next_lon")} / (next_arrival - departure_time) AS v FROM hops WHERE next_arrival > departure_time"""


def _segments(value: str, having: str = "") -> str:
    keys = ", ".join(f"round({s}[{i}], 3) + 0e0 AS {n}_{c}" for n, s in (("start", "a"), ("finish", "b")) for i, c in ((1, "lat"), (2, "lon")))
    return view("hops", seg=_SEG) + f"SELECT * FROM (SELECT {keys}, round({value} * 3.6e0, 6) AS speed_kmh, count(*) AS count FROM seg GROUP BY 1, 2, 3, 4) {having}"


@query("x29_segments_avg", _segments("avg(v)", "WHERE speed_kmh < 120"))
def x29a(t):
    return stats.segment_speed(t.hops(), "avg", 120.0)


@query("x29_segments_p99", _segments("quantile_cont(v, 0.99)"))
def x29p(t):
    return stats.segment_speed(t.hops(), "p99")


@query(
    "x30_longest",
    view("pat", pd=_PD)
    + f""", s AS (SELECT DISTINCT source, pattern, stop_id, stop_name, stop_lat, stop_lon FROM pd),
p AS (SELECT l.source, l.pattern, l.stop_id AS l_id, r.stop_id AS r_id, l.stop_name AS l_name, r.stop_name AS r_name, round({haversine("l.stop_lat", "l.stop_lon", "r.stop_lat", "r.stop_lon")}, 3) AS dist
  FROM s l JOIN s r ON l.source = r.source AND l.pattern = r.pattern AND l.stop_id < r.stop_id),
k AS (SELECT *, row_number() OVER (PARTITION BY source, pattern ORDER BY dist DESC, l_id, r_id) AS k FROM p)
SELECT dist, l_name, r_name, source FROM (SELECT DISTINCT dist, l_name, r_name, source, l_id, r_id FROM k WHERE k = 1) ORDER BY dist DESC, source, l_id, r_id LIMIT 500""",
)
def x30(t):
    return stats.longest_routes(t.patterned())


@query("x31_race_pairs")
def x31(t):
    # written tables, as the pipeline has them: the plan over the raw view repeats its joins many times
    day = materialize(_pattern_day(t), "day")
    s = stats.stop_statistics(day, merged=False, to_terminal=True)
    return race.race_pairs(materialize(edges.hops(day), "hops"), s, t.population(), n=3650, seed=7)


@query(
    "x33_sparkline",
    view("st")
    + f""", g AS (SELECT source, least(23, floor(departure_time * 24e0 / 86400e0)) AS s, count(*) AS c FROM st WHERE departure_time < 86400 GROUP BY ALL), f AS (SELECT source, s, coalesce(c, 0) AS c FROM (SELECT * FROM (SELECT DISTINCT source FROM g) CROSS JOIN (SELECT CAST(s AS DOUBLE) AS s FROM range(24) t(s))) LEFT JOIN g USING (source, s))
SELECT source, string_agg(substr('{aggs.BARS}', CAST(ceil(c * 8 / m) AS INTEGER) + 1, 1), '' ORDER BY s) AS bar FROM (SELECT *, max(c) OVER (PARTITION BY source) AS m FROM f) GROUP BY source""",
)
def x33(t):
    return stats.activity_sparkline(t.stop_times(), "source", "departure_time")


@query(
    "x34_counters",
    view("trips", "routes") + "SELECT source, count(DISTINCT route_type) AS n_route_types, count(DISTINCT trip_headsign) AS n_headsigns, count(DISTINCT direction_id) AS n_directions FROM trips LEFT JOIN routes USING (source, route_id) GROUP BY source",
)
def x34(t):
    return stats.feed_counters(t.trips(), t.routes())


@query("x35_stop_lookup", view("stops") + "SELECT source, stop_id, stop_name FROM stops WHERE stop_name ILIKE '%0007%' AND source LIKE 'f%'")
def x35(t):
    return t.stops().where(F.col("stop_name").ilike("%0007%") & F.col("source").like("f%")).select("source", "stop_id", "stop_name")


# --- single operators -----------------------------------------------------------------------------------------------------------------------


@query("j05_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j05(t):
    return t.raw("customer").join(t.raw("orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("j06_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j06(t):
    return t.raw("customer").join(t.raw("orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("j09_any_join", "SELECT c_custkey, o.o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
def j09(t):
    one = aggs.distinct_on(t.raw("orders"), ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")
    return t.raw("customer").join(one, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query(
    "j18_mutual",
    view("hops", e="SELECT DISTINCT stop_id AS src, next_stop AS dst FROM hops") + "SELECT e.src, e.dst FROM e JOIN e b ON e.src = b.dst AND e.dst = b.src",
)
def j18(t):
    return race.mutual_edges(t.hops().select(F.col("stop_id").alias("src"), F.col("next_stop").alias("dst")))


@query("a09_heavy", "SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS value FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey")
def a09(t):
    return aggs.heavy(t.raw("orders"), ["o_custkey"], "o_orderpriority")


@query("a11_argmin_tuple", "SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, -o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def a11(t):
    return t.raw("orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderpriority", -F.col("o_totalprice"), "o_orderkey")).alias("o_orderkey"))


@query(
    "a18_weighted_median",
    "WITH w AS (SELECT c_mktsegment, c_nationkey, sum(floor(abs(c_acctbal))) AS w FROM customer GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS run, sum(w) OVER (PARTITION BY c_mktsegment) AS t FROM w WHERE w > 0) SELECT c_mktsegment, min(c_nationkey) AS value FROM r WHERE 2 * run >= t GROUP BY c_mktsegment",
)
def a18(t):
    return aggs.weighted_median(t.raw("customer").withColumn("w", F.floor(F.abs("c_acctbal"))), ["c_mktsegment"], "c_nationkey", "w")


@query("a19_topk", "SELECT l_returnflag, l_suppkey, n, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey) AS k FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE k <= 5")
def a19(t):
    return aggs.top_k(t.raw("lineitem"), ["l_returnflag"], "l_suppkey", 5)


@query("a22_distinct_on", "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def a22(t):
    return aggs.distinct_on(t.raw("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query(
    "a29_weighted_curve",
    "WITH w AS (SELECT p_brand, p_size, count(*) AS w FROM part GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY p_brand ORDER BY p_size) AS run, sum(w) OVER (PARTITION BY p_brand) AS t FROM w) SELECT p_brand, round(p / 100e0, 6) AS p, min(p_size) AS p_size FROM r, range(101) g(p) WHERE run * 100 >= p * t GROUP BY ALL",
)
def a29(t):
    return aggs.weighted_curve(t.raw("part").withColumn("w", F.lit(1)), ["p_brand"], "p_size", "w")


@query("a30_cum_share", "SELECT s_suppkey, s_nationkey, round(sum(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey ROWS UNBOUNDED PRECEDING) / nullif(sum(s_suppkey) OVER (PARTITION BY s_nationkey), 0), 6) AS share FROM supplier")
def a30(t):
    return aggs.cumulative_share(t.raw("supplier"), ["s_nationkey"], ["s_acctbal", "s_suppkey"], "s_suppkey").select("s_suppkey", "s_nationkey", "share")


@query("a31_ecdf", "SELECT p_partkey, round(CASE WHEN max(q) OVER w > min(q) OVER w THEN (q - min(q) OVER w) / (max(q) OVER w - min(q) OVER w) ELSE 1e0 END, 6) AS quantile FROM (SELECT p_partkey, p_brand, cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size) AS q FROM part) WINDOW w AS (PARTITION BY p_brand)")
def a31(t):
    return aggs.rescaled_ecdf(t.raw("part"), ["p_brand"], "p_size").select("p_partkey", "quantile")


@query("w04_first_last", "SELECT event_id, first(event_id) OVER w AS first_id, last(event_id) OVER w AS last_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def w04(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return t.raw("events").select("event_id", F.first("event_id").over(w).alias("first_id"), F.last("event_id").over(w).alias("last_id"))


@query("w09_window_over_agg", "SELECT event_type, user_id, count(*) AS c, round(count(*) / max(count(*)) OVER (PARTITION BY event_type), 6) AS share FROM events GROUP BY event_type, user_id")
def w09(t):
    return aggs.normalised(t.raw("events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("c")), ["event_type"], "c")


@query("u01_union_distinct", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def u01(t):
    return t.raw("customer").select(F.col("c_nationkey").alias("nationkey")).union(t.raw("supplier").select("s_nationkey")).distinct()


@query("f11_datediff_boundary", "SELECT event_id, date_diff('minute', p, ts) AS minutes FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NOT NULL")
def f11(t):
    from pyspark.sql import Window as W

    e = t.raw("events").withColumn("p", F.lag("ts").over(W.partitionBy("user_id").orderBy("ts"))).where("p IS NOT NULL")
    return e.select("event_id", timestamp_minutes_between(F.col("p"), F.col("ts")).alias("minutes"))


@query("f36_array_sort_key", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_totalprice, o_orderkey), ',') AS orders_by_price FROM orders GROUP BY o_custkey")
def f36(t):
    pairs = F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey")))
    return t.raw("orders").groupBy("o_custkey").agg(F.array_join(F.transform(pairs, lambda p: p["o_orderkey"].cast("string")), ",").alias("orders_by_price"))


@query(
    "f45_hex_grid",
    view("people") + f"SELECT cell, round({center('cell')[0]}, 6) AS lat, round({center('cell')[1]}, 6) AS lon, count(*) AS n FROM {cells('people', 9, 'lat', 'lon')} GROUP BY cell",
)
def f45(t):
    lat, lon = hex_center(F.col("cell"))
    return t.people().groupBy(hex_cell(F.col("lat"), F.col("lon"), 9).alias("cell")).agg(F.count(F.lit(1)).alias("n")).select("cell", lat.alias("lat"), lon.alias("lon"), "n")


@query("f47_hex_rings", view("people") + f", c AS (SELECT DISTINCT cell FROM {cells('people', 6, 'lat', 'lon')}), r AS ({rings(3)}) SELECT CAST(cell + delta AS BIGINT) AS near, min(k) AS steps, count(*) AS n FROM c, r GROUP BY near")
def f47(t):
    c = t.people().select(hex_cell(F.col("lat"), F.col("lon"), 6).alias("cell")).distinct()
    near = c.select("cell", F.explode(hex_disk(F.col("cell"), 3)).alias("near"))
    return near.groupBy("near").agg(F.min(hex_distance(F.col("cell"), F.col("near"))).alias("steps"), F.count(F.lit(1)).alias("n"))
