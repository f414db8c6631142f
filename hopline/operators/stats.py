"""Questions about departures, speeds, stops and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopline.functions import aggs
from hopline.functions.geo import haversine_m, hex_cell
from hopline.functions.timefn import DAY, minutes_between
from hopline.session import materialize

# Priority of route types, the first that holds.
PRIORITY = [
    (1, [1100], []),
    (2, [4, 1000, 1200], []),
    (3, [2, 12], [(100, 117)]),
    (4, [1], [(400, 405)]),
    (5, [0, 5], [(900, 906)]),
    (6, [6, 7, 1400], [(1300, 1307)]),
    (7, [], [(200, 209)]),
    (8, [11, 800], []),
    (9, [3], [(700, 716)]),
]


def route_priority(route_type: Column) -> Column:
    """1 air, 2 ferry, 3 rail, 4 metro, 5 tram, 6 aerial, 7 coach, 8 trolleybus, 9 bus, 999 other."""
    out = None
    for rank, codes, spans in PRIORITY:
        test = route_type.isin(codes) if codes else F.lit(False)
        for low, high in spans:
            test = test | route_type.between(low, high)
        out = F.when(test, rank) if out is None else out.when(test, rank)
    return out.otherwise(999)


def is_train(route_type: Column) -> Column:
    return (route_type == 2) | route_type.between(100, 199)


def hourly_share(departures: DataFrame, by: str, ts: str) -> DataFrame:
    """(by, hour, c, share): departures of each hour that has any, and their share of the busiest hour."""
    hourly = departures.groupBy(by, F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("c"))
    return aggs.normalised(hourly, [by], "c")


def utilisation_quartiles(departures: DataFrame, by: str, ts: str) -> DataFrame:
    """(by, q): quartiles of the hourly share."""
    return hourly_share(departures, by, ts).groupBy(by).agg(F.percentile("share", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))


def trip_spans(stop_times: DataFrame, by: list[str]) -> DataFrame:
    return stop_times.groupBy(*by, "trip_id").agg(F.min("departure_time").alias("first"), F.max("arrival_time").alias("last"))


def active_probes(stop_times: DataFrame, by: list[str], step_min: int = 5) -> DataFrame:
    """(by, probe, c): trips under way at each probe of the day, both ends included; zero where there are none.

    A trip that passes midnight counts to the end of its day, and what passes is counted from 00:00 on, as another trip. Each interval is one more at its
    first probe and one less after its last, whatever its length; the counts are running sums over the probes of a day.
    """
    grid = stop_times.select(*by).distinct().withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DAY // (step_min * 60) - 1).cast("long"))))
    out = grid.join(_changes(_probed(stop_times, by, step_min), by), [*by, "p"], "left")
    c = F.sum(F.coalesce("d", F.lit(0))).over(W.partitionBy(*by).orderBy("p").rowsBetween(W.unboundedPreceding, W.currentRow))
    return out.select(*by, (F.col("p") * step_min * 60).cast("int").alias("probe"), c.alias("c"))


def _probed(stop_times: DataFrame, by: list[str], step_min: int) -> DataFrame:
    """(by, a, b): first and last probe of each trip that has one under way, by day."""
    step = step_min * 60
    spans = trip_spans(stop_times, by if "source" in by else [*by, "source"])
    today = spans.where(F.col("first") < DAY).select(*by, F.col("first").alias("a"), F.least("last", F.lit(DAY - 1)).alias("b"))
    night = spans.where(F.col("last") >= DAY).select(*by, F.greatest(F.col("first") - DAY, F.lit(0)).alias("a"), (F.col("last") - DAY).alias("b"))
    return today.unionAll(night).withColumn("a", F.ceil(F.col("a") / step)).withColumn("b", F.floor(F.least("b", F.lit(DAY - 1)) / step)).where("a <= b")


def _changes(intervals: DataFrame, by: list[str]) -> DataFrame:
    """(by, p, d): by how much the number under way changes at probe p, where it does."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("p"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("p"), F.lit(-1).alias("d")))).alias("x")
    return intervals.select(*by, ends).groupBy(*by, F.col("x.p").alias("p")).agg(F.sum("x.d").alias("d")).where("d != 0")


def active_patterns(day: DataFrame, step_min: int = 5) -> DataFrame:
    """(country, probe, active_routes): share of the stopping patterns of a country (two letters of the source) with a trip under way.

    Only the probes at which a pattern begins or ends to be active go on from it.
    """
    by, country = ["source", "sane_route_id"], F.left("source", F.lit(2)).alias("country")
    slots = DAY // (step_min * 60)
    c = F.sum("d").over(W.partitionBy(*by).orderBy("p").rowsBetween(W.unboundedPreceding, W.currentRow))
    now = _changes(_probed(day, by, step_min), by).withColumn("c", c)
    was = F.coalesce(F.lag("c").over(W.partitionBy(*by).orderBy("p")), F.lit(0))
    turns = now.select(country, "p", ((F.col("c") > 0).cast("int") - (was > 0).cast("int")).alias("d")).groupBy("country", "p").agg(F.sum("d").alias("d"))
    patterns = day.select(*by).distinct().groupBy(country).agg(F.count(F.lit(1)).alias("n"))
    grid = patterns.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))).join(turns, ["country", "p"], "left")
    active = F.sum(F.coalesce("d", F.lit(0))).over(W.partitionBy("country").orderBy("p").rowsBetween(W.unboundedPreceding, W.currentRow))
    return grid.select("country", (F.col("p") * step_min * 60).cast("int").alias("probe"), (active / F.col("n")).alias("active_routes"))


def active_by_country(day: DataFrame, letters: int = 2, step_min: int = 5) -> DataFrame:
    """(country, probe, c, share): trips under way by country (first letters of the source), and their share of the country's busiest probe."""
    probes = active_probes(day, ["source"], step_min).groupBy(F.left("source", F.lit(letters)).alias("country"), "probe").agg(F.sum("c").alias("c"))
    return aggs.normalised(probes, ["country"], "c")


def headways(stop_times: DataFrame, keys: list[str], low: int = 1, high: int = 120) -> DataFrame:
    """Each departure with ``headway``, minutes since the last one of its keys, prev_departure and prev_trip; only those from ``low`` to ``high``."""
    w = W.partitionBy(*keys).orderBy("departure_time", "trip_id", "stop_sequence")
    prev = {"prev_departure": "departure_time", "prev_trip": "trip_id"}
    out = stop_times.withColumns({n: F.lag(c).over(w) for n, c in prev.items()})
    return out.withColumn("headway", minutes_between(F.col("prev_departure"), F.col("departure_time"))).where(F.col("headway").between(low, high))


def headway_histogram(stop_times: DataFrame, keys: list[str], by: str = "source", low: int = 1, high: int = 120) -> DataFrame:
    return headways(stop_times, keys, low, high).groupBy(by, "headway").agg(F.count(F.lit(1)).alias("n"))


TAKTS = [10.0, 15.0, 30.0, 60.0, 120.0]


def is_takt(headway: Column, mode: str, rtol: float = 0.05) -> Column:
    """Clock-face headways. weighted: near a usual one; strict: divides the hour, or two hours; lenient: within five minutes of dividing it."""
    h = headway
    if mode == "weighted":
        return aggs.near_any(h.cast("double"), TAKTS, rtol)
    rest = F.lit(60) % h
    return (rest == 0) | (h == 120) if mode == "strict" else F.least(rest, h - rest) <= 5


def takt_score(heads: DataFrame, by: list[str], mode: str = "strict", weight: str | None = None) -> DataFrame:
    """(by, value): share of headways that are clock-face, weighted if asked."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    hit = is_takt(F.col("headway"), mode).cast("double")
    return heads.groupBy(*by).agg((F.sum(w * hit) / F.sum(w)).alias("value"))


def legs(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Consecutive stops of each trip: prev_stop, prev_departure, metres, minutes. The two lookups of the stop table share its small side."""
    w = W.partitionBy("source", "trip_id").orderBy("departure_time", "stop_sequence")
    moved = stop_times.withColumns({"prev_stop": F.lag("stop_id").over(w), "prev_departure": F.lag("departure_time").over(w)}).where("prev_stop IS NOT NULL")
    place = lambda n: stops.select("source", F.col("stop_id").alias(f"{n}_id"), F.col("stop_lat").alias(f"{n}_lat"), F.col("stop_lon").alias(f"{n}_lon"))
    a, b = place("from"), place("to")
    out = moved.withColumn("from_id", F.col("prev_stop")).withColumn("to_id", F.col("stop_id")).join(a, ["source", "from_id"]).join(b, ["source", "to_id"])
    out = out.withColumn("metres", haversine_m(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")))
    return out.withColumn("minutes", minutes_between(F.col("prev_departure"), F.col("departure_time"))).drop("from_id", "to_id")


def speed_histogram(stop_times: DataFrame, stops: DataFrame, by: str = "source") -> DataFrame:
    """(by, speed, c): km/h between departures of consecutive stops, to the next ten, from 0 to 400."""
    v = F.try_divide(F.col("metres") / F.lit(1000.0), F.col("minutes") / F.lit(60.0))
    out = legs(stop_times, stops).withColumn("speed", F.round(v, -1)).where(F.col("speed").between(0, 400))
    return out.groupBy(by, "speed").agg(F.count(F.lit(1)).alias("c"))


def dwell_histogram(stop_times: DataFrame, by: str = "source") -> DataFrame:
    """(by, dwell_time, c): minutes between arrival and departure, above 0."""
    d = minutes_between(F.col("arrival_time"), F.col("departure_time"))
    return stop_times.select(by, d.alias("dwell_time")).where("dwell_time > 0").groupBy(by, "dwell_time").agg(F.count(F.lit(1)).alias("c"))


def dwell_share(stop_times: DataFrame, by: str = "source", below: int = 20) -> DataFrame:
    """(by, dwell_percent, c): part of each trip's time that it stands, of dwells under ``below`` minutes, to two decimals."""
    d = minutes_between(F.col("arrival_time"), F.col("departure_time"))
    trips = stop_times.groupBy("source", by, "trip_id") if by != "source" else stop_times.groupBy("source", "trip_id")
    sums = trips.agg(F.sum(F.when(d < below, d).otherwise(0)).alias("d"), minutes_between(F.min("departure_time"), F.max("arrival_time")).alias("t"))
    share = F.round(F.try_divide(F.col("d").cast("double"), F.col("t").cast("double")), 2)
    return sums.select(by, share.alias("dwell_percent")).where("dwell_percent IS NOT NULL").groupBy(by, "dwell_percent").agg(F.count(F.lit(1)).alias("c"))


def trip_list(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """One row for each (source, distance, time) of whole trips: trip_id, dt, at, total_t, start_stop, end_stop, total_dist (km)."""
    order = F.struct("departure_time", "stop_sequence")
    d = legs(stop_times, stops).groupBy("source", "trip_id").agg(F.round(F.sum("metres") / F.lit(1000.0), 3).alias("total_dist"))
    ends = stop_times.groupBy("source", "trip_id").agg(
        F.min("departure_time").alias("dt"), F.max("arrival_time").alias("at"), F.min_by("stop_id", order).alias("a"), F.max_by("stop_id", order).alias("b")
    )
    t = ends.join(d, ["source", "trip_id"]).withColumn("total_t", minutes_between(F.col("dt"), F.col("at")))
    t = aggs.distinct_on(t, ["source", "total_dist", "total_t"], [F.col("trip_id")])
    names = stops.select("source", "stop_id", "stop_name")
    t = t.join(names.select("source", F.col("stop_id").alias("a"), F.col("stop_name").alias("start_stop")), ["source", "a"])
    t = t.join(names.select("source", F.col("stop_id").alias("b"), F.col("stop_name").alias("end_stop")), ["source", "b"])
    return t.select("source", "trip_id", "dt", "at", "total_t", "start_stop", "end_stop", "total_dist")


def best_od(trips: DataFrame) -> DataFrame:
    """Best case of each pair of ends: fastest speed (km/h), median distance, least time, with the speed's quantile and the time-weighted share of distance."""
    v = F.try_divide(F.col("total_dist"), F.col("total_t") / F.lit(60.0))
    best = trips.withColumn("speed", v).where("speed IS NOT NULL").groupBy("source", "start_stop", "end_stop").agg(
        F.max("speed").alias("speed"), F.median("total_dist").alias("total_dist"), F.min("total_t").alias("total_t")
    )
    best = materialize(best, "best")
    best = aggs.rescaled_ecdf(best, ["source"], "speed", "speed_quantile")
    best = best.withColumn("__d", F.col("speed") * F.col("total_t"))
    return aggs.cumulative_share(best, ["source"], ["speed", "start_stop", "end_stop"], "__d", "dist_share").drop("__d")


def calls_per_cell(day: DataFrame, res: int) -> DataFrame:
    """(cell, value): stop times in each cell."""
    return day.groupBy(hex_cell(F.col("stop_lat"), F.col("stop_lon"), res).alias("cell")).agg(F.count(F.lit(1)).alias("value"))


def heavy_route_type(day: DataFrame, res: int) -> DataFrame:
    """(cell, value): the most frequent route type of each cell."""
    return aggs.heavy(day.withColumn("cell", hex_cell(F.col("stop_lat"), F.col("stop_lon"), res)), ["cell"], "route_type")


def bedtime(day: DataFrame, res: int = 5, share: float = 0.5, after: int = 17 * 3600, half_open: bool = False) -> DataFrame:
    """(cell, bedtime): the first hour from ``after`` on, over two days, at which a cell has some, but at most ``share`` of its busiest hour's departures.

    An hour's departures are those from it to 60 minutes on, both included unless ``half_open``: a departure on the hour counts for two.
    """
    cell = hex_cell(F.col("stop_lat"), F.col("stop_lon"), res)
    hour = F.floor(F.col("departure_time") / 3600).cast("int")
    both = F.array(hour) if half_open else F.when(F.col("departure_time") % 3600 == 0, F.array(hour - 1, hour)).otherwise(F.array(hour))
    probes = day.select(cell.alias("cell"), F.explode(both).alias("h")).where("h BETWEEN 0 AND 47").groupBy("cell", "h").agg(F.count(F.lit(1)).alias("c"))
    quiet = aggs.normalised(probes, ["cell"], "c").where((F.col("h") * 3600 >= after) & (F.col("share") > 0) & (F.col("share") <= share))
    return quiet.groupBy("cell").agg((F.min("h") * 3600).alias("bedtime"))


def lunch(day: DataFrame, res: int = 8, at: int = 12 * 3600) -> DataFrame:
    """(cell, value): arrivals of the hour that ends at ``at`` (from 59 minutes before) over those of the cell's busiest such hour."""
    minute = F.floor(F.col("arrival_time") / 60)
    probe = (F.ceil(minute / 60) * 3600).cast("int")
    cell = hex_cell(F.col("stop_lat"), F.col("stop_lon"), res)
    probes = day.where(F.col("arrival_time") < DAY).groupBy(cell.alias("cell"), probe.alias("p")).agg(F.count(F.lit(1)).alias("c"))
    return aggs.normalised(probes, ["cell"], "c", out="value").where(F.col("p") == at).select("cell", "value")


def pattern_boxes(day: DataFrame) -> DataFrame:
    """(sane_route_id, source, crow_km): from corner to corner of each pattern's bounding box."""
    box = day.groupBy("source", "sane_route_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("stop_lat", "stop_lon") for n, f in (("lo", F.min), ("hi", F.max))))
    km = haversine_m(F.col("hi_stop_lat"), F.col("hi_stop_lon"), F.col("lo_stop_lat"), F.col("lo_stop_lon")) / F.lit(1000.0)
    return box.select("source", "sane_route_id", km.alias("crow_km"))


def stop_statistics(day: DataFrame, merged: bool = True, to_terminal: bool = False, stop: str = "stop_uuid") -> DataFrame:
    """How far each stop's patterns go, and its representative place, name and route type (best priority, then most departures).

    merged: by ``stop``; else by (stop_id, source, stop). to_terminal: the distance to the pattern's last stop (latest arrival) instead of its box.
    """
    keys = [stop] if merged else ["stop_id", "source", stop]
    if to_terminal:
        last = day.groupBy("source", "sane_route_id").agg(F.max_by(F.struct("stop_lat", "stop_lon"), F.struct("arrival_time", "stop_id")).alias("t"))
        far = day.select("source", "sane_route_id", *[k for k in keys if k != "source"], "stop_lat", "stop_lon").distinct().join(last, ["source", "sane_route_id"])
        far = far.withColumn("crow_km", haversine_m(F.col("stop_lat"), F.col("stop_lon"), F.col("t.stop_lat"), F.col("t.stop_lon")) / F.lit(1000.0))
    else:
        far = day.select("source", "sane_route_id", *[k for k in keys if k != "source"]).distinct().join(pattern_boxes(day), ["source", "sane_route_id"])
    reach = far.groupBy(*keys).agg(F.max("crow_km").alias("crow_km"))
    shown = ["stop_lat", "stop_lon", "stop_name", "route_type"]
    counts = day.groupBy(*keys, *shown).agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(route_priority(F.col("route_type")), -F.col("n"), F.struct(*shown))
    best = counts.groupBy(*keys).agg(F.min_by(F.struct(*shown), rank).alias("b"))
    return reach.join(best, keys, "left").select("crow_km", *keys, *(F.col(f"b.{c}").alias(c) for c in shown))


def overnight(edges: DataFrame, exclude: tuple[str, ...] = ("ca", "in", "us"), n: int = 100) -> DataFrame:
    """The trips by train that arrive latest on a later day: source, trip_id, departure stop and time, arrival stop and time."""
    kept = edges.where(is_train(F.col("route_type")))
    for c in exclude:
        kept = kept.where(~F.col("source").startswith(c))
    first, last = F.struct("departure_time", "stop_sequence"), F.struct("next_arrival", "stop_sequence")
    t = kept.groupBy("source", "trip_id").agg(
        F.min_by("stop_id", first).alias("departure"), F.min("departure_time").alias("departure_t"), F.max_by("next_stop", last).alias("arrival"), F.max("next_arrival").alias("arrival_t")
    )
    t = t.where(F.floor(F.col("departure_t") / DAY) < F.floor(F.col("arrival_t") / DAY))
    return t.orderBy(F.desc("arrival_t"), "source", "trip_id").limit(n)


def segment_speed(edges: DataFrame, stat: str = "avg", below: float | None = None) -> DataFrame:
    """(start_lat, start_lon, finish_lat, finish_lon, speed_kmh, count) of undirected segments, ends in order and to three decimals against platform noise."""
    here, there = F.struct(F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon")), F.struct(F.col("next_lat").alias("lat"), F.col("next_lon").alias("lon"))
    a, b = F.when(here < there, here).otherwise(there), F.when(here < there, there).otherwise(here)
    v = haversine_m(F.col("stop_lat"), F.col("stop_lon"), F.col("next_lat"), F.col("next_lon")) / (F.col("next_arrival") - F.col("departure_time"))
    e = edges.where("next_arrival > departure_time").select(a.alias("a"), b.alias("b"), v.alias("v"))
    ends = {f"{n}_{c}": F.round(F.col(f"{s}.{c}"), 3) for n, s in (("start", "a"), ("finish", "b")) for c in ("lat", "lon")}
    value = F.avg("v") if stat == "avg" else F.percentile("v", F.lit(0.99))
    out = e.groupBy(*(c.alias(n) for n, c in ends.items())).agg((value * F.lit(3.6)).alias("speed_kmh"), F.count(F.lit(1)).alias("count"))
    return out.where(F.col("speed_kmh") < below) if below is not None else out


def longest_routes(day: DataFrame, n: int = 500) -> DataFrame:
    """(dist, l_name, r_name, source): the two stops of each pattern that are farthest apart, the ``n`` longest.

    Pairs are made within the distinct stops of a pattern, which a vehicle's run bounds.
    """
    s = day.select("source", "sane_route_id", "stop_id", "stop_name", "stop_lat", "stop_lon").distinct()
    side = lambda p: s.select("source", "sane_route_id", *(F.col(f"stop_{c}").alias(f"{p}_{c}") for c in ("id", "name", "lat", "lon")))
    pairs = side("l").join(side("r"), ["source", "sane_route_id"]).where("l_id < r_id")
    pairs = pairs.withColumn("dist", F.round(haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")), 3))
    best = pairs.groupBy("source", "sane_route_id").agg(F.min(F.struct((-F.col("dist")).alias("d"), "l_id", "r_id", "l_name", "r_name")).alias("m"))
    rows = best.select((-F.col("m.d")).alias("dist"), "m.l_name", "m.r_name", "source", "m.l_id", "m.r_id").distinct()
    return rows.orderBy(F.desc("dist"), "source", "l_id", "r_id").limit(n).select("dist", "l_name", "r_name", "source")


def activity_sparkline(departures: DataFrame, by: str, seconds: str, n: int = 24) -> DataFrame:
    """(by, bar): departures over the day as text."""
    return aggs.spark_bar(departures.withColumn("__one", F.lit(1)), [by], seconds, "__one", 0, DAY, n)


def feed_counters(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """(source, n_route_types, n_headsigns, n_directions)."""
    both = trips.join(routes.select("source", "route_id", "route_type"), ["source", "route_id"], "left")
    return both.groupBy("source").agg(
        F.countDistinct("route_type").alias("n_route_types"), F.countDistinct("trip_headsign").alias("n_headsigns"), F.countDistinct("direction_id").alias("n_directions")
    )
