"""Hand-made feeds and small tables, against plain Python."""

import datetime as dt
import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from hopline.functions import aggs, geo, timefn
from hopline.functions.geo import hex_cell
from hopline.operators import clusters, edges, facts, race, routing, service, stats
from hopline.operators.components import connected_components
from hopline.sources import gtfs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def feed_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("feeds")
    files = {
        "aa/stops.txt": 'stop_id,stop_name,stop_lat,stop_lon\nA,"Alpha, north",48.0,2.0\nB,Beta,48.1,2.1\nC,Gamma,,\n',
        "bb/stops.txt": "stop_lon,extra,stop_lat,stop_id\n3.0,x,47.0,A\n3.1,y,47.1,B\n3.2,z,bad,C\n",
        "aa/routes.txt": "route_id,route_type,route_short_name\nR,2,one\n",
        "bb/routes.txt": "route_type,route_id\n3,R\n",
        "aa/trips.txt": "route_id,service_id,trip_id,direction_id\nR,S,T1,0\nR,S,T2,x\nR,E,T3,1\n",
        "bb/trips.txt": "trip_id,route_id,service_id\nT1,R,S\n",
        "aa/calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nS,1,1,1,1,1,0,0,20250106,20250112\n",
        "aa/calendar_dates.txt": "service_id,date,exception_type\nS,20250107,2\nS,20250111,1\nE,20250108,1\n",
        "bb/calendar_dates.txt": "date,service_id,exception_type\n20250109,S,1\n",
        "aa/stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT1,23:50:00,23:50:00,A,1\nT1,24:20:00,24:21:00,B,2\nT2,08:00:00,08:00:00,B,1\nT2,bad,,A,2\nT3,09:00:00,09:00:00,A,1\nT3,09:30:00,09:30:00,B,2\n",
        "bb/stop_times.txt": "stop_id,trip_id,departure_time,arrival_time,stop_sequence\nA,T1,10:00:00,10:00:00,1\nB,T1,10:40:00,10:40:00,2\n",
    }
    for name, text in files.items():
        path = root / f"source={name}"
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    return str(root)


def test_headers_bind_by_name(spark, feed_root):
    got = {(r.source, r.stop_id): (r.stop_name, r.stop_lat, r.stop_lon) for r in gtfs.read_table(spark, feed_root, "stops").collect()}
    assert got["aa", "A"] == ("Alpha, north", 48.0, 2.0) and got["bb", "A"] == ("", 47.0, 3.0)
    assert got["aa", "C"] == ("Gamma", 0.0, 0.0) and got["bb", "C"][1] == 0.0
    assert {r.source for r in gtfs.read_table(spark, feed_root, "stops", "a*").collect()} == {"aa"}
    assert gtfs.headers(spark, feed_root, "stops")["bb"] == ["stop_lon", "extra", "stop_lat", "stop_id"]
    assert gtfs.read_table(spark, feed_root, "agency").count() == 0


def test_times(spark, feed_root):
    got = {(r.source, r.trip_id, r.stop_id): (r.arrival_time, r.departure_time) for r in gtfs.read_table(spark, feed_root, "stop_times").collect()}
    assert got["aa", "T1", "B"] == (87600, 87660) and got["aa", "T2", "A"] == (None, None)
    df = spark.createDataFrame([(59, 60), (0, 59), (60, 179)], "a int, b int")
    assert [r[0] for r in df.select(timefn.minutes_between(F.col("a"), F.col("b"))).collect()] == [1, 0, 1]
    assert spark.range(1).select(timefn.clock(F.lit(87660))).first()[0] == "24:21:00"
    at = spark.range(1).select(timefn.on_day(F.lit("2025-01-01").cast("date"), F.lit(87660))).first()[0]
    assert at == dt.datetime(2025, 1, 2, 0, 21)


def test_services(spark, feed_root):
    cal, dates = (gtfs.read_table(spark, feed_root, t) for t in ("calendar", "calendar_dates"))
    active = service.active_services(cal, dates, dt.date(2025, 1, 6), dt.date(2025, 1, 12))
    got = {(s, i, d.day) for s, i, d in rows(active)}
    assert got == {("aa", "S", d) for d in (6, 8, 9, 10, 11)} | {("aa", "E", 8), ("bb", "S", 9)}
    best = service.best_day(active)
    assert [(s, d.day, n) for s, d, n in rows(best)] == [("aa", 8, 2), ("bb", 9, 1)]
    trips = gtfs.read_table(spark, feed_root, "trips")
    assert rows(service.valid_trips(trips.union(trips), active, best)) == [("aa", "T1"), ("aa", "T2"), ("aa", "T3"), ("bb", "T1")]
    assert rows(service.services_on(cal, dates, dt.date(2025, 1, 7))) == []


def test_whole_ingest(spark, feed_root, tmp_path):
    from hopline.plans.pipeline import Ingest

    people = spark.createDataFrame([(48.0, 2.0, 10), (47.0, 3.0, 5)], "lat double, lon double, population long")
    pop = people.select(geo.hex_cell(F.col("lat"), F.col("lon"), 9).alias("cell"), "population")
    job = Ingest(spark, feed_root, str(tmp_path))
    job.run(dt.date(2025, 1, 6), pop, days=7)
    assert job.table("one_day").count() == 8 and job.table("one_day_sane").select("source", "sane_route_id").distinct().count() == 2
    edge = {(r.source, r.trip_id): (r.next_stop, r.travel_time, r.next_pop) for r in job.table("edgelist").collect()}
    assert edge == {("aa", "T1"): ("B", 30, 10), ("aa", "T3"): ("B", 30, 10), ("bb", "T1"): ("B", 40, 5)}
    assert job.table("edgelist_ext").where("trip_id = 'T1' AND source = 'aa'").select("initial_name", "final_name").first()[1] == "Beta"
    baked = job.table("pop_within_60_baked")
    assert {r.res for r in baked.select("res").distinct().collect()} <= set(range(4, 11))
    before = baked.count()
    job.access()
    assert job.table("pop_within_60_baked").count() == before
    stat = {r.stop_id: r.crow_km for r in job.table("stop_statistics_terminal").where("source = 'aa'").collect()}
    assert stat["B"] == pytest.approx(stat["A"], abs=20) and job.table("stop_statistics").count() >= 2


def test_sinks(spark, tmp_path):
    import json

    df = spark.createDataFrame([(10, 0.5), (255, 1.0)], "index long, value double")
    gtfs.write_map_layer(df, str(tmp_path / "map"), "title", flip=True)
    text = next((tmp_path / "map" / "data").glob("*.csv")).read_text().splitlines()
    assert text == ["index,value", "a,0.5", "ff,1.0"]
    assert json.loads(next((tmp_path / "map" / "meta").glob("*.txt")).read_text())["flip"] is True
    assert spark.createDataFrame([("ff",)], "s string").select(gtfs.cell_id(F.col("s"))).first()[0] == 255
    import pyarrow as pa

    assert pa.ipc.open_stream(gtfs.arrow_bytes(df)).read_all().num_rows == 2
    gtfs.write_table(df, str(tmp_path / "t"), ["index"])
    gtfs.append(df, str(tmp_path / "t"))
    assert gtfs.swap_in(spark.read.parquet(str(tmp_path / "t")).limit(1), str(tmp_path / "t")).count() == 1
    gtfs.drop_table(spark, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()


def test_patterns_and_reversal(spark):
    day = [("f", t, s, d, k) for t, stops in {1: "ABC", 2: "ABC", 3: "CBA", 4: "ABA"}.items() for k, (s, d) in enumerate(zip(stops, (10, 20, 20)))]
    df = spark.createDataFrame(day, "source string, trip_id int, stop_id string, departure_time int, stop_sequence int")
    ids = {t: p for _, t, p, _ in rows(facts.stopping_patterns(df))}
    assert ids[1] == ids[2] and len(set(ids.values())) == 3


def test_hex_grid(spark):
    rnd = random.Random(2)
    points = [(rnd.uniform(-60, 60), rnd.uniform(-179, 179)) for _ in range(300)] + [(0.0, 0.0)]
    df = spark.createDataFrame(points, "lat double, lon double")
    for res in (3, 9, 11):
        c = df.select("lat", "lon", geo.hex_cell(F.col("lat"), F.col("lon"), res).alias("c"))
        lat, lon = geo.hex_center(F.col("c"))
        out = c.select(
            "c", geo.hex_cell(lat, lon, res).alias("again"), geo.hex_resolution(F.col("c")).alias("res"), geo.hex_disk(F.col("c"), 4).alias("disk"),
            geo.hex_ring(F.col("c"), 4).alias("ring"), geo.hex_parent(F.col("c"), res - 1).alias("up"), geo.hex_distance(F.col("c"), F.col("c") + geo.steps(3, True)[0]).alias("three"),
            geo.hex_ring(F.col("c"), 0)[0].alias("own"),
        )
        for r in out.collect():
            assert r.c == r.again == r.own and r.res == res and len(set(r.disk)) == 61 and len(set(r.ring)) == 24 and set(r.ring) <= set(r.disk) and r.three == 3 and r.up >> 58 == res - 1
    assert geo.ring_deltas(spark, 30).count() == 2791
    assert geo.edge_m(9) == pytest.approx(174.4, abs=0.2) and geo.edge_m(10) == pytest.approx(65.9, abs=0.1)
    d = spark.range(1).select(geo.haversine_m(F.lit(48.85), F.lit(2.35), F.lit(51.5), F.lit(-0.12)), geo.haversine_m(F.lit(51.5), F.lit(-0.12), F.lit(48.85), F.lit(2.35))).first()
    assert d[0] == d[1] == pytest.approx(342_000, rel=0.01)


def test_stop_clusters_are_transitive(spark):
    step = 20 / 111_000
    stops = [("f", i, 45.0 + i * step, 2.0) for i in range(3)] + [("f", 9, 46.0, 2.0), ("f", 10, 0.0, 0.0)]
    df = spark.createDataFrame(stops, "source string, stop_id int, stop_lat double, stop_lon double")
    found = clusters.stop_clusters(df)
    named = clusters.with_stop_uuid(df, found)
    ids = {r.stop_id: r.stop_uuid for r in named.collect()}
    assert ids[0] == ids[1] == ids[2] != ids[9] and 10 not in ids


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = sorted((x, root(x)) for x in list(parent))
    assert rows(connected_components(spark.createDataFrame([*pairs, (None, 3)], "src long, dst long"))) == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_earliest_arrivals_against_brute_force(spark):
    rnd = random.Random(4)
    hops = [(rnd.randrange(12), rnd.randrange(12), d := rnd.randrange(0, 5000), d + rnd.randrange(60, 900)) for _ in range(150)] + [(99, 1, 10, 20)]
    best = {0: 100}
    changed = True
    while changed:
        changed = False
        for a, b, d, t in hops:
            if a in best and d >= best[a] and d >= 100 and t <= 4000 and t < best.get(b, 1 << 30):
                best[b], changed = t, True
    e = spark.createDataFrame(hops, "stop long, next_stop long, departure_time int, next_arrival int")
    assert rows(routing.earliest_arrivals(e, spark.createDataFrame([(0,)], "stop long"), 100, 4000)) == sorted(best.items())


def test_isochrone(spark):
    base = [(1, 45.0, 2.0), (2, 45.3, 2.3), (3, 45.6, 2.6)]
    place = {s: (a, o) for s, a, o in base}
    hops = [(1, 2, 61_300, 63_000), (2, 3, 63_100, 64_800), (1, 3, 61_300, 68_300)]
    e = spark.createDataFrame([(a, b, d, t, *place[a]) for a, b, d, t in hops] + [(3, 1, 80_000, 81_000, *place[3])], "stop long, next_stop long, departure_time int, next_arrival int, lat double, lon double")
    e = e.withColumn("cell", geo.hex_cell(F.col("lat"), F.col("lon"), 7))
    got = [(r.arrival_time, round(r.actual_value, 3), r.value) for r in routing.isochrone(e, 2.0, 45.0).collect()]
    assert got == [(64_800, round(1 - 60 / 120, 3), 0.0), (63_000, 0.75, 0.5), (61_200, 1.0, 1.0)]
    alone = routing.isochrone(e, 100.0, 10.0).collect()
    assert [(r.actual_value, r.value) for r in alone] == [(0.0, 1.0)]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("a", 10, 4)], "g string, v int, w int")
    assert rows(aggs.weighted_median(df, ["g"], "v", "w")) == [("a", 2)]
    curve = {p: v for _, p, v in rows(aggs.weighted_curve(df, ["g"], "v", "w", 4))}
    assert curve == {0.0: 1, 0.25: 2, 0.5: 2, 0.75: 10, 1.0: 10}
    bars = rows(aggs.spark_bar(spark.createDataFrame([("a", 0, 8), ("a", 5, 1), ("a", 9, 4)], "g string, x int, y int"), ["g"], "x", "y", 0, 10, 5))
    assert bars == [("a", "█ ▁ ▄")]
    assert rows(aggs.heavy(spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("a", 2)], "g string, v int"), ["g"], "v")) == [("a", 1)]
    s = aggs.weighted_sample(spark.range(1000).withColumn("w", (F.col("id") < 10).cast("double") * 1e6 + 1), "w", 10, 5, ["id"])
    assert {r.id for r in s.collect()} == set(range(10))


def test_route_priority(spark):
    codes = {1100: 1, 4: 2, 12: 3, 117: 3, 118: 999, 405: 4, 0: 5, 1400: 6, 203: 7, 800: 8, 3: 9, 77: 999}
    df = spark.createDataFrame([(k,) for k in codes], "t int")
    assert {r.t: r.p for r in df.select("t", stats.route_priority(F.col("t")).alias("p")).collect()} == codes


def test_overnight_probes(spark):
    st = spark.createDataFrame([("f", 1, 85_800, 85_800, 1), ("f", 1, 87_600, 87_600, 2), ("f", 2, 600, 600, 1), ("f", 2, 900, 900, 2)], "source string, trip_id int, arrival_time int, departure_time int, stop_sequence int")
    on = {r.probe: r.c for r in stats.active_probes(st, ["source"]).collect() if r.c}
    assert on == {85_800: 1, 86_100: 1, 0: 1, 300: 1, 600: 2, 900: 2, 1200: 1} and stats.active_probes(st, ["source"]).count() == 288


def test_race_pairs(spark):
    base = [(45.0 + i * 0.5, 2.0 + i * 0.7) for i in range(6)]
    hops = [(*base[i], *base[j]) for i in range(6) for j in range(6) if abs(i - j) == 1]
    h = spark.createDataFrame(hops, "stop_lat double, stop_lon double, next_lat double, next_lon double")
    s = spark.createDataFrame([(a, o, 50.0) for a, o in base], "stop_lat double, stop_lon double, crow_km double")
    pop = s.select(geo.hex_cell(F.col("stop_lat"), F.col("stop_lon"), 9).alias("cell"), F.lit(100).alias("population"))
    pairs = race.race_pairs(h, s, pop, n=40, seed=3)
    got = rows(pairs)
    assert len(got) > 30 and got == rows(pairs)
    for _, a, b, c, d in got:
        assert math.hypot((c - a) * 111, (d - b) * 78) > 95 and {(a, b), (c, d)} <= set(base)


def test_segments_and_speeds(spark):
    e = spark.createDataFrame([(45.0, 2.0, 45.1, 2.0, 0, 600), (45.1, 2.0, 45.0, 2.0, 0, 300), (45.0, 2.0, 45.1, 2.0, 9, 9)], "stop_lat double, stop_lon double, next_lat double, next_lon double, departure_time int, next_arrival int")
    (one,) = stats.segment_speed(e).collect()
    assert (one.start_lat, one.finish_lat, one["count"]) == (45.0, 45.1, 2) and one.speed_kmh == pytest.approx((66.7 + 133.4) / 2, abs=0.2)
    assert stats.segment_speed(e, below=50.0).count() == 0


def test_hops_drop_last_and_same_stop(spark):
    day = spark.createDataFrame([("f", 1, "A", 0, 60, 1), ("f", 1, "A", 300, 360, 2), ("f", 1, "B", 600, 660, 3)], "source string, trip_id int, stop_id string, arrival_time int, departure_time int, stop_sequence int")
    day = day.withColumn("stop_lat", F.lit(1.0)).withColumn("stop_lon", F.lit(1.0))
    assert [(r.stop_sequence, r.next_stop, r.travel_time) for r in edges.hops(day).collect()] == [(2, "B", 4)]


def test_stream_equals_batch(spark, tmp_path):
    from hopline.streaming import activity

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ddl = ", ".join(f"{n} {t}" for n, t in e.dtypes)
    e.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    flow = activity.hourly_activity(activity.read_departures(spark, str(tmp_path / "in"), ddl), "event_type", "ts", late="40 days")
    q = activity.keep_table(flow, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    live = flow.writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    live.awaitTermination(120)
    batch = stats.hourly_share(e, "event_type", "ts").select("event_type", F.col("hour").cast("timestamp"), "c")
    assert rows(spark.table("live")) == rows(batch)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("gone", ["hopline.llm", "corpus_pipeline", "public_tokenizers", "xxhash"])
def test_entry_without_corpus_operators(gone):
    """In a process of its own, in which a part cannot be imported, the timetable queries are still there."""
    code = f"""
import importlib.abc, sys
class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {gone!r}:
            raise ImportError(name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as entry
names = set(entry.queries())
assert "x07_edgelist" in names and "s18_arrow_and_back" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(entry.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True)


def test_finishes_that_are_hard_to_find(spark, monkeypatch):
    """With one try each, draws that miss take one of the cells that are far enough away."""
    lat = [48.0, 48.1, 48.2, 50.0]
    hops = spark.createDataFrame([(a, 2.0, b, 2.0) for i, a in enumerate(lat) for b in lat if a != b], "stop_lat double, stop_lon double, next_lat double, next_lon double")
    s = spark.createDataFrame([(x, 2.0, 5.0) for x in lat], "stop_lat double, stop_lon double, crow_km double")
    people = spark.createDataFrame([(x, 2.0, 1000 if x < 50 else 1) for x in lat], "lat double, lon double, population long").select(hex_cell(F.col("lat"), F.col("lon"), 9).alias("cell"), "population")
    out = race.race_pairs(hops, s, people, n=40, seed=3, attempts=1).collect()
    assert len(out) == 40 and all({r["start_lat"], r["finish_lat"]} >= {50.0} or abs(r["start_lat"] - r["finish_lat"]) > 1 for r in out)


def test_arrow_files(spark, tmp_path):
    import pyarrow as pa

    table = pa.table({"a": [1, 2, None], "b": ["x", None, "z"]})
    (tmp_path / "f").mkdir()
    with pa.ipc.new_file(str(tmp_path / "f" / "one.arrow"), table.schema) as w:
        w.write_table(table)
    got = gtfs.read_arrow(spark, str(tmp_path / "f"), spark.createDataFrame([], "b string, a long").schema, single=True)
    assert sorted(map(tuple, got.collect()), key=str) == [("x", 1), ("z", None), (None, 2)]
    gtfs.write_arrow(got.where("false"), str(tmp_path / "g"))
    assert gtfs.read_arrow(spark, str(tmp_path / "g"), got.schema).count() == 0
