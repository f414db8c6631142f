"""Mixing sources to target weights by weighted fair queueing.

Each copy of a document gets a virtual finish time, the tokens of its source up to and including it divided by the target of the source. The copies
are put into one global order by that time and cut where the total budget is reached. Documents of a source queue in a keyed hash order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopline.llm.common import with_row_key
from hopline.session import discard, materialize

#: Documents of a block that one task orders at a time, on average, and blocks of a source at least (fewer for a small corpus).
ROWS_PER_BLOCK, LEAST_BLOCKS = 20_000, 64
#: Sources up to which their table is broadcast (about 100 bytes each); beyond, it is joined.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeats: float) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Sources by code point, null last, take ``weights`` in turn. The budget, ``share`` times the total, is shared by weight; no target exceeds
    ``max_repeats`` times the size, and what is cut off is shared again by weight. That fixed point is a water level L with
    target = min(cap, L * weight): in order of cap / weight the sources below the level are full, so L comes from two running sums.
    """
    if not all(w > 0 for w in weights):
        raise ValueError("weights must be above zero")
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("weight"), (F.lit(float(max_repeats)) * F.col("source_size")).alias("cap"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    from_last = W.orderBy((F.col("cap") / F.col("weight")).desc(), F.col("source").isNull().desc(), F.col("source").desc())
    everything = W.partitionBy()
    s = s.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(everything)).alias("budget"),
        F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(from_last.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("rest"),  # its own and those after it
    )
    level = (F.col("budget") - F.col("full")) / F.col("rest")
    # the level is right for the first source, in that order, that it does not fill
    s = s.withColumn("level", F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), level.alias("x")))).over(everything)["x"])
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def queue(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_repeats: int = 2,
    row_key: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, order): one row (__row, doc_id, size, source_size, target) for each document, and the copies taken in mixing order (__row, copy, finish).

    A null source is a source of its own; null or empty texts have size 0 and are never taken; repeated ids are separate rows. Weights must be above zero.
    ``__row`` numbers the rows and is stable, as they are written; ``row_key`` names a column of ``docs`` that the rows carry along, by which to find them again. An empty table gives two empty results.
    """
    slim = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")]
    rows = with_row_key(docs.select(*slim, *([row_key] if row_key else [])))
    carried = [row_key] if row_key else []
    rows = rows.withColumn("rnd", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = materialize(rows, "sizes")
    n = rows.count()
    sources = materialize(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats), "targets")
    hint = F.broadcast if sources.count() <= BROADCAST_SOURCES else (lambda x: x)
    # running sums within a source, in two levels: over blocks of the hash order, then within a block, so that no task holds a whole source
    bits = min(28, max((n // ROWS_PER_BLOCK).bit_length(), min(LEAST_BLOCKS, math.isqrt(n)).bit_length()))
    block = F.shiftright(F.conv(F.substring("rnd", 1, 7), 16, 10).cast("long"), 28 - bits)
    rows_b = rows.withColumn("block", block)
    sums = rows_b.groupBy("source", "block").agg(F.sum("size").alias("s"))
    before = sums.select(
        "source", "block", F.coalesce(F.sum("s").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    inner = W.partitionBy("source", "block").orderBy("rnd", "doc_id", "__row").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows_b.withColumn("cum", F.sum("size").over(inner)).alias("a").join(
        before.alias("b"), F.expr("a.source <=> b.source AND a.block = b.block")
    ).select("a.__row", "a.doc_id", "a.source", "a.size", *(F.col(f"a.{c}") for c in carried), (F.col("before") + F.col("cum")).alias("cum"))
    placed = placed.alias("a").join(hint(sources).alias("t"), F.expr("a.source <=> t.source")).select(
        "__row", "doc_id", "size", *carried, "source_size", "target", "cum"
    )
    placed = materialize(placed, "placed")
    discard(rows)
    copies = placed.where("size > 0").select(
        "__row", "doc_id", "size", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("copy"), "source_size", "target", "cum"
    )
    copies = copies.withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("cum")) / F.col("target"))
    budget = F.lit(float(share)) * F.sum("size")
    # the cut: slices of the virtual time from a histogram, and an exact order only within the slice where the budget runs out
    slices = min(1 << 16, max(1, 2 * n // ROWS_PER_BLOCK) * 4)
    cut = copies.withColumn("slice", F.least(F.floor(F.col("finish") * slices), F.lit(4 * slices)))
    running = cut.groupBy("slice").agg(F.sum("size").alias("s")).select("slice", F.sum("s").over(W.orderBy("slice")).alias("upto"), "s")
    limit = placed.agg(F.coalesce(budget, F.lit(0.0)).alias("budget")).scalar()
    edge = running.where(F.col("upto") > limit).agg(F.min(F.struct("slice", (F.col("upto") - F.col("s")).alias("below"))).alias("e"))
    cut = cut.withColumn("e", edge.scalar())
    whole = cut.where("e IS NULL OR slice < e.slice")
    last = cut.where("slice = e.slice").withColumn(
        "upto", F.col("e.below") + F.sum("size").over(W.orderBy("finish", "doc_id", "__row", "copy").rowsBetween(W.unboundedPreceding, W.currentRow))
    ).where(F.col("upto") <= placed.agg(F.coalesce(budget, F.lit(0.0)).alias("budget")).scalar())
    taken = whole.select("__row", "copy", "finish", "size").unionByName(last.select("__row", "copy", "finish", "size"))
    return placed, taken


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus: whole rows of ``docs``, a row as often as it is taken, range-sorted by virtual finish time.

    Null, empty and blank texts have no words and are never taken; a null source is a source of its own; an empty table gives an empty result; columns of
    any name come through; very long texts count whole. Copies with one finish time are ordered by id, row and copy.
    Rows are known by 128 bits of a hash of all their columns, which does not depend on how a job splits the files. Equal rows are interchangeable: one of
    them stands for all, and is taken as often as they are together.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    nulls = F.concat(*(c.isNull().cast("string") for c in cols))  # a null does not change a hash
    named = [f"k{i}" for i in range(len(docs.columns))]
    key = F.struct(F.xxhash64(nulls, *cols).alias("a"), F.xxhash64(F.lit(1), nulls, *cols).alias("b")).alias("__key")
    roles = {p: docs.columns.index(params.pop(p, default)) for p, default in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    keyed = docs.select(*(c.alias(k) for c, k in zip(cols, named)), key)
    cols = [F.col(k) for k in named]
    placed, taken = queue(keyed, row_key="__key", **{p: named[i] for p, i in roles.items()}, **params)
    order = taken.join(placed.select("__row", "__key"), "__row").select(
        F.col("__key").alias("__k"), F.struct(F.col("finish").alias("__finish"), F.col("__row").alias("__r"), F.col("copy").alias("__copy")).alias("__at")
    )
    many = placed.groupBy("__key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("__key").alias("__k"))
    order = order.join(many.withColumn("__many", F.lit(True)), "__k", "left")
    once = keyed.join(order.where("__many IS NULL"), F.col("__key") == F.col("__k")).select(*cols, "__at.*")
    one = keyed.join(many, F.col("__key") == F.col("__k"), "left_semi").dropDuplicates(["__key"])
    again = one.join(order.where("__many"), F.col("__key") == F.col("__k")).select(*cols, "__at.*")
    joined = once.unionByName(again)
    spread = joined.repartitionByRange("__finish", "__r", "__copy").sortWithinPartitions("__finish", "__r", "__copy")
    return spread.select(*(F.col(k).alias(c) for k, c in zip(named, docs.columns)))
