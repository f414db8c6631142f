"""Queries that exercise a single operator, source or conversion each, with their DuckDB counterparts; the questions of ``catalog`` use the others.

Texts that a conversion reads are made from the driver tables, half of them malformed. Sources read back what a sink has written to the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hopline.functions.geo import hex_cell, hex_disk
from hopline.functions.timefn import date_or_zero, on_day, seconds_of, time_of_day, tumble_hour
from hopline.operators import stats
from hopline.plans.catalog import _HEADKEYS, _PROBE, query
from hopline.plans.oracle import cells, rings, view
from hopline.session import shared_dir
from hopline.sources import gtfs


def _folder(t) -> str:
    return f"{shared_dir(t.spark)}/hopline/probe-{uuid.uuid4().hex}"


# --- filters and keys -----------------------------------------------------------------------------------------------------------------------

_HOME = f"SELECT cell AS home FROM {cells('(SELECT * FROM stops WHERE source = ' + chr(39) + 'f0' + chr(39) + ' AND stop_id = 1)', 7)}"


@query("p13_in_array", view("stops", home=_HOME, ring=rings(6)) + f"SELECT source, stop_id FROM {cells('stops', 7)} WHERE cell IN (SELECT home + delta FROM home, ring)")
def p13(t):
    cell = hex_cell(F.col("stop_lat"), F.col("stop_lon"), 7)
    home = t.stops().where("source = 'f0' AND stop_id = 1").agg(F.max(cell)).scalar()
    return t.stops().withColumn("home", home).where(F.array_contains(hex_disk(F.col("home"), 6), cell)).select("source", "stop_id")


@query("p12_in_list", view("stops") + "SELECT source, stop_id FROM stops WHERE stop_id IN (3, 5, 8) AND source NOT IN ('f1', 'f2')")
def p12(t):
    return t.stops().where(F.col("stop_id").isin(3, 5, 8) & ~F.col("source").isin("f1", "f2")).select("source", "stop_id")


@query("p14_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def p14(t):
    o = t.raw("orders")
    return o.where(F.col("o_totalprice") > o.agg(F.avg("o_totalprice")).scalar()).select("o_orderkey")


@query("p03_lateral_alias", "SELECT o_orderkey, round(o_totalprice / 2, 4) AS half, round(round(o_totalprice / 2, 4) / 5, 4) AS tenth FROM orders")
def p03(t):
    t.raw("orders").createOrReplaceTempView("__p03")
    return t.spark.sql("SELECT o_orderkey, round(o_totalprice / 2, 4) AS half, round(half / 5, 4) AS tenth FROM __p03")


_KEYED = """SELECT *, CASE WHEN route_type IN (2, 109) THEN trip_headsign ELSE route_id END AS line FROM day"""


@query(
    "w10_conditional_partition",
    view("day", k=_KEYED) + "SELECT * FROM (SELECT source, stop_id, trip_id, stop_sequence, departure_time - lag(departure_time) OVER (PARTITION BY source, stop_id, line ORDER BY departure_time, trip_id, stop_sequence) AS gap FROM k) WHERE gap IS NOT NULL",
)
def w10(t):
    line = F.when(F.col("route_type").isin(2, 109), F.col("trip_headsign")).otherwise(F.col("route_id"))
    w = W.partitionBy("source", "stop_id", line).orderBy("departure_time", "trip_id", "stop_sequence")
    return t.day().select("source", "stop_id", "trip_id", "stop_sequence", (F.col("departure_time") - F.lag("departure_time").over(w)).alias("gap")).where("gap IS NOT NULL")


@query("p20_conditional_group", view("day", k=_KEYED) + "SELECT source, line, count(*) AS n FROM k GROUP BY ALL")
def p20(t):
    line = F.when(F.col("route_type").isin(2, 109), F.col("trip_headsign")).otherwise(F.col("route_id")).alias("line")
    return t.day().groupBy("source", line).agg(F.count(F.lit(1)).alias("n"))


@query(
    "o02_order_by_element",
    """SELECT event_type, round(q[2], 6) AS median FROM (SELECT event_type, quantile_cont(c, [0.25, 0.5, 0.75]) AS q FROM (SELECT event_type, user_id, count(*) AS c FROM events GROUP BY ALL) GROUP BY event_type)
ORDER BY q[2] DESC, event_type LIMIT 2""",
)
def o02(t):
    c = t.raw("events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("c"))
    q = c.groupBy("event_type").agg(F.percentile("c", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.orderBy(F.element_at("q", 2).desc(), "event_type").limit(2).select("event_type", F.element_at("q", 2).alias("median"))


@query("o08_sample_first", "SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000) GROUP BY o_orderstatus")
def o08(t):
    return t.raw("orders").orderBy("o_orderkey").limit(1000).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# --- arrays and shapes ----------------------------------------------------------------------------------------------------------------------

_BASKETS = "SELECT l_orderkey, list(DISTINCT l_suppkey % 20) AS a, list(DISTINCT l_partkey % 20) AS b FROM lineitem GROUP BY l_orderkey"


def _baskets(t):
    return t.raw("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 20).alias("a"), F.collect_set(F.col("l_partkey") % 20).alias("b"))


@query("u05_array_intersect", f"WITH x AS ({_BASKETS}) SELECT l_orderkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS both FROM x")
def u05(t):
    both = F.array_sort(F.array_intersect("a", "b"))
    return _baskets(t).select("l_orderkey", F.array_join(both.cast("array<string>"), ",").alias("both"))


@query("f37_has", f"WITH x AS ({_BASKETS}) SELECT l_orderkey, list_contains(b, 7) AS has_b FROM x WHERE list_contains(a, 7) OR NOT list_contains(b, 3)")
def f37(t):
    return _baskets(t).where(F.array_contains("a", 7) | ~F.array_contains("b", 3)).select("l_orderkey", F.array_contains("b", 7).alias("has_b"))


@query("f38_array_push", f"WITH x AS ({_BASKETS}) SELECT l_orderkey, array_to_string(list_append(list_sort(a), -1), ',') AS pushed FROM x")
def f38(t):
    return _baskets(t).select("l_orderkey", F.array_join(F.array_append(F.array_sort("a"), F.lit(-1)).cast("array<string>"), ",").alias("pushed"))


@query("f35_array_filter", f"WITH x AS ({_BASKETS}) SELECT l_orderkey, CAST(len(list_filter(a, lambda v: v > 9)) AS INTEGER) AS n FROM x")
def f35(t):
    return _baskets(t).select("l_orderkey", F.size(F.filter("a", lambda v: v > 9)).alias("n"))


@query(
    "v03_stack",
    "SELECT o_custkey, what, round(sum(v), 2) AS total FROM (SELECT o_custkey, unnest(['price', 'priority']) AS what, unnest([o_totalprice, CAST(left(o_orderpriority, 1) AS DOUBLE)]) AS v FROM orders) GROUP BY ALL",
)
def v03(t):
    wide = t.raw("orders").select("o_custkey", F.col("o_totalprice").cast("double").alias("price"), F.left("o_orderpriority", F.lit(1)).cast("double").alias("priority"))
    return wide.unpivot("o_custkey", ["price", "priority"], "what", "v").groupBy("o_custkey", "what").agg(F.round(F.sum("v"), 2).alias("total"))


@query("a07_group_by_array", view("pat") + "SELECT source, array_to_string(stops, '-') AS pattern, count(*) AS trips FROM pat GROUP BY source, stops")
def a07(t):
    from hopline.operators import facts

    order = F.array_sort(F.collect_list(F.struct("departure_time", "stop_sequence", "stop_id")))
    stops = t.day().groupBy("source", "trip_id").agg(F.transform(order, lambda x: x["stop_id"]).alias("stops"))
    counted = stops.groupBy("source", "stops").agg(F.count(F.lit(1)).alias("trips"))
    # the id of the operator names the same groups
    ids = facts.stopping_patterns(t.day()).groupBy("source", "sane_route_id").agg(F.count(F.lit(1)).alias("trips"), F.min("trip_id").alias("trip_id"))
    named = ids.join(stops, ["source", "trip_id"]).select("source", "stops", "trips")
    return counted.join(named, ["source", "stops", "trips"]).select("source", F.array_join(F.col("stops").cast("array<string>"), "-").alias("pattern"), "trips")


# --- lookups --------------------------------------------------------------------------------------------------------------------------------


@query("x35b_lookup_by_id", view("day") + "SELECT source, trip_id, stop_sequence, stop_name, departure_time FROM day WHERE source = 'f1' AND trip_id IN (SELECT max(trip_id) FROM day WHERE source = 'f1')")
def x35b(t):
    day = t.day().where("source = 'f1'")
    return day.where(F.col("trip_id") == day.agg(F.max("trip_id")).scalar()).select("source", "trip_id", "stop_sequence", "stop_name", "departure_time")


@query("x35c_lookup_by_cell", view("stops", home=_HOME) + f"SELECT source, stop_id, stop_name FROM {cells('stops', 5)} WHERE cell = (SELECT cell FROM {cells('(SELECT * FROM stops WHERE source = ' + chr(39) + 'f0' + chr(39) + ' AND stop_id = 1)', 5)})")
def x35c(t):
    cell = hex_cell(F.col("stop_lat"), F.col("stop_lon"), 5)
    here = t.stops().where("source = 'f0' AND stop_id = 1").agg(F.max(cell)).scalar()
    return t.stops().where(cell == here).select("source", "stop_id", "stop_name")


_COUNTRY = _PROBE.replace("WITHS", view("day", base="SELECT *, left(source, 1) AS country FROM day WHERE source <> 'f4'").rstrip()).replace("KEYS", "country, source").replace("BASE", "base")


@query(
    "x15d_active_by_country",
    _COUNTRY + ", byc AS (SELECT country, probe, CAST(sum(c) AS BIGINT) AS c FROM act GROUP BY ALL) SELECT country, probe, c, round(c / max(c) OVER (PARTITION BY country), 6) AS share FROM byc",
)
def x15d(t):
    return stats.active_by_country(t.day().where("source <> 'f4'"), letters=1)


# --- conversions ----------------------------------------------------------------------------------------------------------------------------

_TEXTS = """WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'n' || o_orderkey ELSE CAST(o_orderkey * 37 AS VARCHAR) END AS s,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_totalprice AS VARCHAR) END AS f, CASE WHEN o_orderkey % 5 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y%m%d') END AS d,
  lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 70 AS VARCHAR), 2, '0') || ':05' AS h, o_orderdate FROM orders) """


def _texts(t):
    k = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return t.raw("orders").select(
        k.alias("k"), F.when(k % 3 == 0, F.concat(F.lit("n"), k)).otherwise((k * 37).cast("string")).alias("s"), F.when(k % 4 == 0, "").otherwise(F.col("o_totalprice").cast("string")).alias("f"),
        F.when(k % 5 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("d"), F.concat_ws(":", two(k % 30), two(k % 70), F.lit("05")).alias("h"), "o_orderdate",
    )


@query(
    "f01_numbers_of_texts",
    _TEXTS + "SELECT k, coalesce(TRY_CAST(s AS INTEGER), -1) AS i, coalesce(TRY_CAST(s AS INTEGER), 0) AS i0, coalesce(CAST(TRY_CAST(s AS SMALLINT) AS INTEGER), -1) AS i16, coalesce(round(TRY_CAST(f AS DOUBLE), 2), -1) AS f, round(coalesce(TRY_CAST(f AS DOUBLE), 0), 2) AS f0 FROM x",
)
def f01(t):
    s, f = F.col("s"), F.col("f")
    i, x = s.try_cast("int"), f.try_cast("double")
    return _texts(t).select("k", F.coalesce(i, F.lit(-1)).alias("i"), F.coalesce(i, F.lit(0)).alias("i0"), F.coalesce(s.try_cast("smallint").cast("int"), F.lit(-1)).alias("i16"), F.coalesce(F.round(x, 2), F.lit(-1.0)).alias("f"), F.round(F.coalesce(x, F.lit(0.0)), 2).alias("f0"))


@query("f05_flags", _TEXTS + "SELECT k, CAST(k % 2 AS BOOLEAN) AS odd, nullif(s, '74') AS other, lower(upper(s)) AS low, greatest(k, 50) AS g, least(k, 50) AS l FROM x")
def f05(t):
    return _texts(t).select("k", (F.col("k") % 2).cast("boolean").alias("odd"), F.nullif("s", F.lit("74")).alias("other"), F.lower(F.upper("s")).alias("low"), F.greatest("k", F.lit(50)).alias("g"), F.least("k", F.lit(50)).alias("l"))


@query("f09_hex_ids", _TEXTS + "SELECT k, lower(to_hex(k * 7919)) AS h, k * 7919 AS back FROM x")
def f09(t):
    h = F.lower(F.hex(F.col("k") * 7919))
    return _texts(t).select("k", h.alias("h"), gtfs.cell_id(h).alias("back"))


@query(
    "f10_times_of_texts",
    _TEXTS
    + """SELECT k, coalesce(CAST(TRY_STRPTIME(d, '%Y%m%d') AS DATE), DATE '1970-01-01') AS day, CAST(CASE WHEN k % 70 < 60 THEN k % 30 * 3600 + k % 70 * 60 + 5 ELSE -1 END AS INTEGER) AS secs,
  CAST(CASE WHEN k % 70 < 60 THEN k % 30 * 3600 ELSE -1 END AS INTEGER) AS hour_start, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(isodow(o_orderdate) AS INTEGER) AS dow FROM x""",
)
def f10(t):
    secs = seconds_of(F.col("h"))
    return _texts(t).select("k", date_or_zero(F.col("d")).alias("day"), F.coalesce(secs, F.lit(-1)).alias("secs"), F.coalesce(tumble_hour(secs), F.lit(-1)).alias("hour_start"), F.dayofyear("o_orderdate").cast("int").alias("doy"), (F.weekday("o_orderdate") + 1).cast("int").alias("dow"))


@query(
    "f15_add_to_times",
    "SELECT event_id, CAST(ts + INTERVAL 30 MINUTE AS TIMESTAMP) AS plus, CAST(CAST(ts AS DATE) + INTERVAL 26 HOUR AS TIMESTAMP) AS next_day, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS secs FROM events",
)
def f15(t):
    e = t.raw("events")
    ts = F.col("ts").cast("timestamp_ntz")
    return e.select("event_id", (ts + F.expr("INTERVAL 30 MINUTES")).alias("plus"), on_day(ts.cast("date"), F.lit(26 * 3600)).alias("next_day"), time_of_day(ts).alias("secs"))


# --- sources and sinks ----------------------------------------------------------------------------------------------------------------------


def _feeds(t, table: str, df) -> str:
    """Write ``df`` as text feeds, ``source=<feed>/<table>.txt``, and return their root."""
    root = _folder(t)
    for (source,) in sorted(t.trips().select("source").distinct().collect()):
        gtfs.write_text_table(df.where(F.col("source") == source).drop("source"), f"{root}/source={source}/{table}.txt")
    return root


def _stop_feed(t):
    return t.stops().select("source", F.col("stop_id").cast("string").alias("stop_id"), "stop_name", F.when(F.col("stop_id") % 10 == 0, "x").otherwise(F.col("stop_lat").cast("string")).alias("stop_lat"), F.col("stop_lon").cast("string").alias("stop_lon"))


_SHOWN = "SELECT source, CAST(stop_id AS VARCHAR) AS stop_id, stop_name, round(CASE WHEN stop_id % 10 = 0 THEN 0e0 ELSE stop_lat END, 6) AS stop_lat, round(stop_lon, 6) AS stop_lon FROM stops"


@query("s01_text_feeds", view("stops") + f"{_SHOWN} WHERE source IN ('f1', 'f2', 'f3')")
def s01(t):
    return gtfs.read_table(t.spark, _feeds(t, "stops", _stop_feed(t)), "stops", "f[1-3]").select("source", "stop_id", "stop_name", "stop_lat", "stop_lon")


@query("s02_inferred", view("stops") + "SELECT source, CAST(stop_id AS INTEGER) AS stop_id, round(stop_lon, 6) AS stop_lon FROM stops")
def s02(t):
    return gtfs.read_inferred(t.spark, _feeds(t, "stops", _stop_feed(t)), "stops").select("source", "stop_id", "stop_lon")


@query("s06_sorted_table_append_swap", view("stops") + f"{_SHOWN} WHERE source <> 'f4' UNION ALL {_SHOWN} WHERE source = 'f0'")
def s06(t):
    """Written sorted, kept where it is, appended to, and swapped for a part of itself."""
    folder, stops = _folder(t), gtfs.read_table(t.spark, _feeds(t, "stops", _stop_feed(t)), "stops").select("source", "stop_id", "stop_name", "stop_lat", "stop_lon")
    gtfs.write_table(stops, f"{folder}/stops", ["source", "stop_id"])
    gtfs.write_table(stops.limit(0), f"{folder}/stops", mode="ignore")
    gtfs.append(stops.where("source = 'f0'"), f"{folder}/stops")
    return gtfs.swap_in(t.spark.read.parquet(f"{folder}/stops").where("source <> 'f4'"), f"{folder}/stops")


@query("s12_csv_and_back", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def s12(t):
    df, path = t.raw("customer").select("c_custkey", "c_name", "c_nationkey"), _folder(t)
    gtfs.write_csv(df, path)
    return gtfs.read_csv(t.spark, path, df.schema)


@query("s18_arrow_and_back", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def s18(t):
    df, path = t.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate"), _folder(t)
    gtfs.write_arrow(df, path)
    return gtfs.read_arrow(t.spark, path, df.schema)


@query("x16c_headways_of_trains", view("day") + "SELECT source, trip_id, stop_sequence, floor(departure_time / 60) - floor(p / 60) AS headway FROM (SELECT *, lag(departure_time) OVER (PARTITION BY source, stop_id, route_id, direction_id ORDER BY departure_time, trip_id, stop_sequence) AS p FROM day WHERE route_type = 2 OR route_type BETWEEN 100 AND 199) WHERE floor(departure_time / 60) - floor(p / 60) BETWEEN 1 AND 60")
def x16c(t):
    trains = t.day().where(stats.is_train(F.col("route_type")))
    return stats.headways(trains, _HEADKEYS, 1, 60).select("source", "trip_id", "stop_sequence", F.col("headway").cast("double").alias("headway"))

