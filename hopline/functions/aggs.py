"""Aggregates that Spark has no single function for, built from its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopline.session import materialize


def heavy(df: DataFrame, by: list[str], value: str, out: str = "value") -> DataFrame:
    """The most frequent value of each group; the least of those that tie."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(out))


def top_k(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """(by, rank, value, n): the k most frequent values of each group, exact; ties by value."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a given order."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str, out: str = "value") -> DataFrame:
    """Exact weighted median: the first value at which twice the weight so far reaches the total. Equal values are added up before the shuffle."""
    w = df.groupBy(*by, value).agg(F.sum(weight).alias("__w")).where("__w > 0")
    order = W.partitionBy(*by).orderBy(value)
    w = w.withColumn("__c", F.sum("__w").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("__t", F.sum("__w").over(W.partitionBy(*by)))
    return w.where("2 * __c >= __t").groupBy(*by).agg(F.min(value).alias(out))


def weighted_curve(df: DataFrame, by: list[str], value: str, weight: str, points: int = 100) -> DataFrame:
    """(by, p, value): for p = 0, 1/points .. 1, the first value at which the weight so far reaches the share p of the total."""
    w = df.groupBy(*by, value).agg(F.sum(weight).alias("__w")).where("__w > 0")
    order = W.partitionBy(*by).orderBy(value)
    now = F.sum("__w").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    w = w.withColumn("__c", now).withColumn("__t", F.sum("__w").over(W.partitionBy(*by)))
    # each value answers for the points between the weight before it and after it
    first = F.when(F.col("__c") == F.col("__w"), F.lit(0)).otherwise(F.floor((F.col("__c") - F.col("__w")) * points / F.col("__t")) + 1)
    last = F.floor(F.col("__c") * points / F.col("__t"))
    w = w.withColumn("__a", first.cast("int")).withColumn("__b", last.cast("int")).where("__a <= __b")
    return w.select(*by, F.explode(F.sequence("__a", "__b")).alias("__p"), value).select(*by, (F.col("__p") / points).alias("p"), value)


def running_totals(df: DataFrame, by: list[str], order: list[str], of: Column) -> DataFrame:
    """``df`` with __upto, __first and __all: of its group, the sum of ``of`` up to its place in the order (ties included), up to the first place, and whole.

    No task has a whole group: rows are cut into ranges of the order, summed inside each, and the ranges' sums, a row each, are added on top.
    """
    keyed = df.withColumn("__o", F.struct(*order)).withColumn("__v", of)
    sums = keyed.groupBy(*by, "__o").agg(F.sum("__v").alias("__s"))
    ranged = materialize(sums.repartitionByRange(*by, "__o").withColumn("__range", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("__range", *by).orderBy("__o").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranges = ranged.groupBy("__range", *by).agg(F.sum("__s").alias("__t"), F.min_by("__s", "__o").alias("__f"))
    whole = W.partitionBy(*by)
    earlier = F.coalesce(F.sum("__t").over(whole.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("__range", *by, earlier.alias("__before"), F.min_by("__f", "__range").over(whole).alias("__first"), F.sum("__t").over(whole).alias("__all"))
    same = lambda a, b, cols: reduce(Column.__and__, (F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in cols))
    placed = ranged.withColumn("__in", F.sum("__s").over(inside)).alias("a").join(ranges.alias("b"), same("a", "b", ["__range", *by]))
    placed = placed.select(*(f"a.`{c}`" for c in by), "__o", (F.col("__before") + F.col("__in")).alias("__upto"), "__first", "__all")
    out = keyed.drop("__v").alias("a").join(placed.alias("b"), same("a", "b", [*by, "__o"]))
    return out.select("a.*", "__upto", "__first", "__all").drop("__o")


def cumulative_share(df: DataFrame, by: list[str], order: list[str], value: str, out: str = "share") -> DataFrame:
    """Running sum of ``value`` in the given order over its total; rows that tie share the sum up to the last of them."""
    runs = running_totals(df, by, order, F.col(value))
    return runs.withColumn(out, F.try_divide("__upto", "__all")).drop("__upto", "__first", "__all")


def rescaled_ecdf(df: DataFrame, by: list[str], value: str, out: str = "quantile", jiggle: list[str] | None = None) -> DataFrame:
    """The empirical distribution at each value, stretched to 0..1; with ``jiggle`` columns, ties are told apart by them."""
    runs = running_totals(df, by, [value, *(jiggle or [])], F.lit(1))
    share = (F.col("__upto") - F.col("__first")) / (F.col("__all") - F.col("__first"))
    return runs.withColumn(out, F.when(F.col("__all") > F.col("__first"), share).otherwise(F.lit(1.0))).drop("__upto", "__first", "__all")


def normalised(df: DataFrame, by: list[str], value: str, how: str = "max", out: str = "share") -> DataFrame:
    """``value`` over the maximum or the sum of its group."""
    return df.withColumn(out, F.try_divide(F.col(value), getattr(F, how)(value).over(W.partitionBy(*by))))


#: The bars of a text histogram, from low to high.
BARS = " ▁▂▃▄▅▆▇█"


def spark_bar(df: DataFrame, by: list[str], x: str, y: str, low: float, high: float, n: int = 24, out: str = "bar") -> DataFrame:
    """A text histogram of ``n`` bars for each group: y summed over equal slices of [low, high), against the group's highest slice."""
    slot = F.least(F.lit(n - 1), F.floor((F.col(x) - F.lit(float(low))) * F.lit(float(n)) / F.lit(float(high - low)))).cast("int")
    sums = df.where((F.col(x) >= low) & (F.col(x) < high)).groupBy(*by, slot.alias("__s")).agg(F.sum(y).alias("__y"))
    top = sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__s", "__y"))).alias("__m"), F.max("__y").alias("__top"))
    bar = lambda i: F.substring(F.lit(BARS), (F.ceil(F.coalesce(F.try_element_at("__m", i), F.lit(0)) * 8 / F.col("__top")) + 1).cast("int"), F.lit(1))
    return top.select(*by, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), bar), "").alias(out))


def near_any(x: Column, targets: list[float], rtol: float) -> Column:
    """Whether x is within a relative tolerance of any target."""
    return F.exists(F.array(*(F.lit(float(t)) for t in targets)), lambda t: F.abs(x - t) <= F.lit(rtol) * F.greatest(F.abs(x), F.abs(t)))


def weighted_sample(df: DataFrame, weight: str, n: int, seed: int, tie: list[str]) -> DataFrame:
    """``n`` rows without replacement, with chances by weight (exponential keys). The keys hash the ``tie`` columns, so a rerun draws the same rows."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *tie), 11) + 1) / F.lit(float((1 << 53) + 1))
    return df.where(F.col(weight) > 0).withColumn("__key", -F.log(u) / F.col(weight)).orderBy("__key", *tie).limit(n).drop("__key")
