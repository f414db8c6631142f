"""From feeds of text files to all tables: what the reference's orchestrated ingest builds, in one driver program."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hopline.operators import access, clusters, edges, facts, service, stats
from hopline.sources import gtfs
from hopline.sources.schema import TABLES


@dataclass
class Ingest:
    """``root`` holds ``source=<feed>/<table>.txt``; tables go to ``out``. Each step reads what earlier ones wrote."""

    spark: SparkSession
    root: str
    out: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/{name}")

    def _write(self, df: DataFrame, name: str, sort: list[str]) -> DataFrame:
        return gtfs.write_table(df, f"{self.out}/{name}", sort)

    def base_tables(self) -> None:
        for name in TABLES:
            if name != "stop_times":
                gtfs.write_base_table(self.spark, self.root, name, self.out)

    def day(self, first: dt.date, days: int = 60) -> None:
        """Trips of each source's best day, their stop times (filtered before they are written), the denormalised day and its patterns."""
        active = service.active_services(self.table("calendar"), self.table("calendar_dates"), first, first + dt.timedelta(days=days - 1))
        valid = service.valid_trips(self.table("trips"), active, service.best_day(active))
        self._write(valid, "valid_trips", ["source", "trip_id"])
        st = facts.only_valid(gtfs.read_table(self.spark, self.root, "stop_times"), self.table("valid_trips"))
        self._write(st, "stop_times", ["source", "trip_id", "stop_id", "arrival_time", "departure_time"])
        one = facts.one_day(self.table("stop_times"), self.table("trips"), self.table("routes"), self.table("stops"))
        self._write(one, "one_day", ["source", "stop_id", "route_type", "trip_id", "arrival_time"])
        self._write(facts.with_patterns(self.table("one_day")), "one_day_sane", ["source", "stop_id", "sane_route_id", "trip_id"])

    def merge_stops(self) -> None:
        found = clusters.stop_clusters(self.table("stops"))
        self._write(found, "stop_uuids", ["cell", "stop_uuid"])
        self._write(clusters.with_stop_uuid(self.table("one_day_sane"), self.table("stop_uuids")), "one_day_merged", ["source", "sane_route_id", "trip_id", "departure_time"])

    def edges(self, population: DataFrame) -> None:
        sane = edges.edge_list(self.table("one_day_sane"), population)
        self._write(sane, "edgelist", ["source", "stop_id", "trip_id", "next_stop"])
        self._write(edges.edge_list(self.table("one_day_merged"), population, stop="stop_uuid"), "edgelist_merged", ["stop_uuid", "source", "trip_id"])
        self._write(edges.edge_list_ext(self.table("one_day_merged"), stop="stop_uuid"), "edgelist_ext", ["cell", "source", "stop_uuid", "trip_id"])

    def access(self) -> None:
        self._write(access.pop_within_60(self.table("edgelist")), "pop_within_60", ["lon", "lat", "cell"])
        gtfs.swap_in(access.bake(self.table("pop_within_60")), f"{self.out}/pop_within_60_baked")

    def statistics(self) -> None:
        day = self.table("one_day_merged")
        self._write(stats.stop_statistics(day), "stop_statistics", ["stop_lat", "stop_lon", "stop_uuid"])
        self._write(stats.stop_statistics(day, merged=False), "stop_statistics_unmerged", ["stop_lat", "stop_lon", "crow_km", "stop_uuid"])
        self._write(stats.stop_statistics(day, merged=False, to_terminal=True), "stop_statistics_terminal", ["stop_lat", "stop_lon", "crow_km", "stop_uuid"])

    def run(self, first: dt.date, population: DataFrame, days: int = 60) -> None:
        self.base_tables()
        self.day(first, days)
        self.merge_stops()
        self.edges(population)
        self.access()
        self.statistics()
