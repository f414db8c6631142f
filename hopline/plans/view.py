"""The driver tables read as a timetable: trips and stop times from orders and lineitem, stops from suppliers, services from customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopline.functions.geo import hex_cell
from hopline.operators import clusters, edges, facts
from hopline.sources.schema import WEEKDAYS

ROUTE_TYPES = {1: 2, 2: 109, 3: 0, 4: 3, 5: 1100}
SOURCES = 5
FIRST_DAY = "2025-01-01"


def _source(customer: Column) -> Column:
    return F.concat(F.lit("f"), (customer % SOURCES).cast("string"))


class Timetable:
    """Each table as a DataFrame, by the names of the schema."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def departures(self) -> DataFrame:
        e = self.raw("events")
        return e.select(F.col("event_type").alias("source"), F.col("user_id").alias("trip_id"), (F.col("user_id") % 20).alias("stop_id"), F.col("ts").alias("departure_time"), "event_id")

    def trips(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            _source(F.col("o_custkey")).alias("source"), F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("service_id"), F.left("o_orderpriority", F.lit(1)).alias("route_id"),
            (F.col("o_orderkey") % 2).cast("int").alias("direction_id"), F.col("o_orderpriority").alias("trip_headsign"),
        )

    def _per_source(self, df: DataFrame) -> DataFrame:
        return df.withColumn("source", F.explode(F.array(*(F.lit(f"f{i}") for i in range(SOURCES)))))

    def routes(self) -> DataFrame:
        rows = [(str(k), t) for k, t in ROUTE_TYPES.items()]
        return self._per_source(self.spark.createDataFrame(rows, "route_id string, route_type int"))

    def stops(self) -> DataFrame:
        k = F.col("s_suppkey")
        lat = F.lit(44.0) + (k * 37 % 100).cast("double") * F.lit(0.02)
        lon = F.lit(2.0) + (k * 61 % 97).cast("double") * F.lit(0.03)
        return self._per_source(self.raw("supplier").select(k.alias("stop_id"), F.col("s_name").alias("stop_name"), lat.alias("stop_lat"), lon.alias("stop_lon")))

    def stop_times(self) -> DataFrame:
        w = W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_suppkey", "l_partkey")
        li = self.raw("lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_suppkey", "l_partkey").withColumn("seq", F.row_number().over(w))
        arr = ((F.col("l_orderkey") * 7 % 1080 + 300) * 60 + (F.col("seq") - 1) * 900 + F.col("l_partkey") % 10 * 60).cast("int")
        st = li.join(self.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return st.select(
            _source(F.col("o_custkey")).alias("source"), F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("stop_id"), F.col("seq").alias("stop_sequence"), arr.alias("arrival_time"),
            (arr + F.col("l_suppkey") % 3 * 60).cast("int").alias("departure_time"),
        )

    def calendar(self) -> DataFrame:
        k = F.col("c_custkey")
        start = F.date_add(F.lit(FIRST_DAY).cast("date"), (k % 60).cast("int"))
        flags = [((k + j + 1) % 3 != 0).cast("int").alias(d) for j, d in enumerate(WEEKDAYS)]
        return self.raw("customer").select(_source(k).alias("source"), k.alias("service_id"), *flags, start.alias("start_date"), F.date_add(start, (F.col("c_nationkey") + 30).cast("int")).alias("end_date"))

    def calendar_dates(self) -> DataFrame:
        o = self.raw("orders")
        day = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("o_orderkey") % 120).cast("int"))
        return o.select(_source(F.col("o_custkey")).alias("source"), F.col("o_custkey").alias("service_id"), day.alias("date"), (1 + F.col("o_orderkey") % 2).cast("int").alias("exception_type")).distinct()

    def people(self) -> DataFrame:
        k = F.col("c_custkey")
        lat = F.lit(44.0) + (k * 53 % 2000).cast("double") * F.lit(0.001)
        lon = F.lit(2.0) + (k * 71 % 2910).cast("double") * F.lit(0.001)
        return self.raw("customer").where("c_acctbal > 0").select(lat.alias("lat"), lon.alias("lon"), F.floor("c_acctbal").alias("population"))

    def population(self, res: int = 9) -> DataFrame:
        return self.people().groupBy(hex_cell(F.col("lat"), F.col("lon"), res).alias("cell")).agg(F.sum("population").alias("population"))

    def inhabited(self, res: int = 10) -> DataFrame:
        return self.people().select(hex_cell(F.col("lat"), F.col("lon"), res).alias("cell")).distinct()

    def day(self) -> DataFrame:
        return facts.one_day(self.stop_times(), self.trips(), self.routes(), self.stops())

    def patterned(self) -> DataFrame:
        return facts.with_patterns(self.day())

    def clustered(self) -> DataFrame:
        return clusters.with_stop_uuid(self.patterned(), clusters.stop_clusters(self.stops()))

    def edges(self) -> DataFrame:
        return edges.edge_list(self.day(), self.population())

    def hops(self) -> DataFrame:
        return edges.hops(self.day())
