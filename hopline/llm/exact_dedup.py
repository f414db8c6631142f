"""Exact dedup by two Bloom passes; DataFrame functions only.

Pass 1 sets, for each row, one bit in each of two halves of a bit table, and keeps the bits that two or more rows set. Pass 2 tests each row
against the kept bits: a row with both bits is possibly repeated and is grouped by its whole digest, any other row is alone and passes straight through.

A table has BITS_PER_ROW bits a row and a bound in bytes. More rows than it takes are dealt by the first bits of the digest into parts, each of which has
a table of its own; equal digests are in one part. So the share of rows that shuffle does not grow with the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.llm.common import ascii_lower, with_row_key
from hopline.session import discard, materialize

#: Bits of a table. The broadcast holds a long for each 64 bits in which some bit is kept: at most MAX_BITS / 64 rows of 16 bytes (16 MB).
MIN_BITS, MAX_BITS, BITS_PER_ROW = 1 << 16, 1 << 26, 16
#: A digest with more than a HOT-th of all rows is handed back by a broadcast of at most HOT rows.
HOT = 10_000


def _slots(digest: Column, bits: int) -> list[Column]:
    half = F.lit(bits // 2)
    return [F.pmod(F.xxhash64(digest, F.lit(k)), half) + F.lit(k) * half for k in (0, 1)]


def repeated_bits(digests: DataFrame, bits: int) -> DataFrame:
    """(word, mask): the bits that at least two rows of ``digests`` set, 64 to a word."""
    slots = digests.select(F.explode(F.array(*_slots(F.col("digest"), bits))).alias("slot"))
    twice = slots.groupBy("slot").count().where("count > 1")
    bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    return twice.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("mask"))


def parts_of(n_rows: int) -> tuple[int, int]:
    """(parts, bits of each part's table): BITS_PER_ROW bits a row, as a power of two, in tables of at most MAX_BITS."""
    bits = max(MIN_BITS, 1 << (BITS_PER_ROW * max(1, n_rows) - 1).bit_length())
    return max(1, bits // MAX_BITS), min(bits, MAX_BITS)


def part_of(digest: Column, parts: int) -> Column:
    """The part, from the first 28 bits of the digest."""
    return F.pmod(F.conv(F.substring(F.hex(digest), 1, 7), 16, 10).cast("int"), F.lit(parts))


def split_by_bloom(digests: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(possibly repeated, certainly alone) rows of ``digests`` by a table of ``bits`` bits."""
    kept = F.broadcast(repeated_bits(digests, bits))
    probed = digests
    for k, slot in enumerate(_slots(F.col("digest"), bits)):
        side = kept.select(F.col("word").alias(f"__w{k}"), F.col("mask").alias(f"__m{k}"))
        probed = probed.withColumn(f"__s{k}", slot)
        probed = probed.join(side, F.shiftright(f"__s{k}", 6) == F.col(f"__w{k}"), "left")
        probed = probed.withColumn(f"__h{k}", F.coalesce(F.expr(f"getbit(__m{k}, CAST(__s{k} & 63 AS INT)) = 1"), F.lit(False)))
    both = F.col("__h0") & F.col("__h1")
    keep = digests.columns
    return probed.where(both).select(keep), probed.where(~both).select(keep)


def _judged(digests: DataFrame, bits: int, n_rows: int) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) of one part. Digests with very many rows get their group back by a broadcast, so no task has them alone."""
    maybe, alone = split_by_bloom(digests, bits)
    groups = maybe.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "__row")).alias("top"))
    many = F.col("group_size") * HOT > F.lit(n_rows)
    hot = F.broadcast(groups.where(many).select(F.col("digest").alias("__d"), F.col("group_size").alias("__n"), F.col("top").alias("__t")))
    tested = maybe.join(hot, F.col("digest") == F.col("__d"), "left")
    of_hot = tested.where("__d IS NOT NULL").select("id", "__row", "digest", F.col("__n").alias("group_size"), F.col("__t").alias("top"))
    of_rest = tested.where("__d IS NULL").select("id", "__row", "digest").join(groups.where(~many), "digest").select("id", "__row", "digest", "group_size", "top")
    grouped = of_hot.unionByName(of_rest).select("id", F.col("top.id").alias("keep_id"), "group_size", (F.col("__row") == F.col("top.__row")).alias("kept"), "digest")
    single = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return grouped.unionByName(single)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest id stays; a null id is below
    all others, and of rows that share that id exactly one is ``kept``. An empty table gives an empty result; other columns are ignored.
    Only (id, digest) of possibly repeated rows is shuffled, never the text; a digest that a third of all rows hold is counted with map-side partial
    aggregates and handed back by a broadcast. Very long texts are hashed whole. With more than MAX_BITS / BITS_PER_ROW rows the digests are written by
    part, and each part is judged and written for itself.
    """
    rows = with_row_key(docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256)).alias("digest")))
    rows = materialize(rows, "digests")
    n = rows.count()
    parts, bits = parts_of(n)
    if parts == 1:
        out = _judged(rows, bits, n)
    else:
        by_part = materialize(rows.withColumn("part", part_of(F.col("digest"), parts)), "parts", by="part")
        out = reduce(DataFrame.unionByName, (materialize(_judged(by_part.where(F.col("part") == p).drop("part"), bits, n), "judged") for p in range(parts)))
        discard(rows)
        discard(by_part)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
