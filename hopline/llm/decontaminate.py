"""Benchmark decontamination as a prefix-filtered set join; DataFrame functions only.

A window is 13 consecutive words of a benchmark item (a shorter item is one window). A document holds a window only if it holds all its shingles of three
words, so it is enough to look where the rarest of them stands: shingles are ordered by how often all documents hold them, and as all of them must be
there, the necessary prefix of a window is one shingle. Each place where a prefix shingle stands gives one candidate place for the window, which is held
against the bounds of the document and then against the words themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopline.llm.common import ascii_lower
from hopline.session import materialize

WINDOW, SHINGLE = 13, 3
#: Bits of the table that keeps places without a benchmark shingle out of the join: so many a shingle, in two hashes (four places of a thousand pass by
#: chance), within these bounds (16 MB; above four million distinct shingles more pass, and are dropped by the join).
BITS_PER_SHINGLE, MIN_BITS, MAX_BITS = 32, 1 << 16, 1 << 27
#: Windows of the benchmark up to which their prefixes are broadcast (some 150 bytes each, 15 MB); beyond, places and prefixes are shuffled.
BROADCAST_WINDOWS = 100_000
#: A shingle that stands in more than a HOT-th of all places is dealt over so many tasks as it has such shares.
HOT = 1_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of 0-9, a-z and all beyond ASCII, after lower-casing A-Z; null has none."""
    return F.array_remove(F.split(ascii_lower(text), _SEPARATORS), "")


def _shingle(words: Column | str, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(words, at + i) for i in range(k)))


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, item_id, len): each window of each item, its words joined by spaces."""
    w = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)))
    cut = w.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at") + 1, WINDOW).alias("w"))
    return cut.select(F.array_join("w", " ").alias("window"), "item_id", F.size("w").alias("len"), "w").distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, len, off, h, k): the shingles of each distinct window; one of fewer words than a shingle is one shingle."""
    w = windows.select("window", "len", "w").dropDuplicates(["window"])
    k = F.least("len", F.lit(SHINGLE))
    off = F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k")))
    w = w.withColumn("k", k).withColumn("off", off)
    h = F.coalesce(*(F.when(F.col("k") == i, _shingle("w", F.col("off"), i)) for i in range(1, SHINGLE + 1)))
    return w.select("window", "len", "off", h.alias("h"), "k")


def _slots(h: Column, bits: int) -> list[Column]:
    return [F.pmod(h, F.lit(bits)), F.pmod(F.xxhash64(h), F.lit(bits))]


def _bit_table(shingles: DataFrame, bits: int) -> DataFrame:
    """One row: the filter as an array of ``bits`` / 64 longs."""
    slots = shingles.select(F.explode(F.array(*_slots(F.col("h"), bits))).alias("slot")).distinct()
    words = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("i"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits"))
    full = shingles.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("i")).join(words, "i", "left")
    pairs = F.array_sort(F.collect_list(F.struct("i", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return full.agg(F.transform(pairs, lambda p: p["bits"]).alias("table"))


def filter_bits(n_shingles: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_SHINGLE * max(1, n_shingles) - 1).bit_length()))


def places(docs: DataFrame, shingles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, n_words, hits): one row for each row of ``docs``, with the places where a shingle of ``shingles`` (h, k) may stand.

    A hit is (h, at, from, near): the words around place ``at`` that a window with this shingle can reach, beginning with word ``from``.
    """
    kinds = sorted(r["k"] for r in shingles.select("k").distinct().collect())  # at most SHINGLE numbers
    bits = filter_bits(shingles.select("h").distinct().count())
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), words_of(text).alias("w"))
    d = d.withColumn("table", _bit_table(shingles, bits).scalar())  # a scalar subquery: one value of bounded size

    def kept(k: int) -> Column:
        hashed = F.transform("w", lambda w, i: F.struct(_shingle("w", i, k).alias("h"), i.alias("at")))
        bit = lambda slot: F.getbit(F.element_at("table", F.shiftright(slot, 6).cast("int") + 1), F.pmod(slot, F.lit(64)).cast("int")) == 1
        return F.filter(hashed, lambda x: reduce(Column.__and__, map(bit, _slots(x["h"], bits))))

    hits = F.concat(*(kept(k) for k in kinds)) if kinds else F.expr("CAST(array() AS array<struct<h: bigint, at: int>>)")
    low = lambda x: F.greatest(x["at"] - (WINDOW - 1), F.lit(0))
    near = F.transform(
        hits, lambda x: F.struct(x["h"].alias("h"), x["at"].alias("at"), low(x).alias("from"), F.slice("w", low(x) + 1, x["at"] - low(x) + WINDOW).alias("near"))
    )
    return d.select("doc_id", "tie", F.size("w").cast("long").alias("n_words"), near.alias("hits"))


def _met(hits: DataFrame, prefix: DataFrame, held: DataFrame, few: bool) -> DataFrame:
    """``hits`` with the windows (window, len, h, off) of their shingle; a hot shingle is dealt over several tasks where neither side is broadcast."""
    if few:
        return hits.join(F.broadcast(prefix), "h")
    shares = F.ceil(F.col("c") * HOT / held.agg(F.sum("c")).scalar()).cast("int")
    hot = held.select("h", shares.alias("shares")).where("shares > 1")  # less than HOT rows
    dealt = lambda df: df.join(F.broadcast(hot), "h", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    one = dealt(hits).withColumn("share", F.pmod(F.xxhash64("doc_id", "tie", "at"), F.col("shares")).cast("int")).drop("shares")
    two = dealt(prefix).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    return one.join(two, ["h", "share"]).drop("share")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, tie, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit; a document is contaminated if it has a hit and at least a twentieth of its words are. ``tie`` is a
    hash of the text, which tells rows that share an id apart; repeated rows get each the same result. Null texts and items have no words; with no items,
    nothing is hit. A null item id counts as an item but is left out of ``items_sha256``. Other columns are ignored.

    Very long texts are read whole; a window that ties with others for its rarest shingle takes the least. Texts are read once and never shuffled. With a small benchmark only matches are; with a large one, the places that its shingles can stand at, with
    25 words around each.
    """
    windows = materialize(windows_of(items, item_id_col, item_text_col), "windows")
    shingles = materialize(window_shingles(windows), "shingles")
    found = materialize(places(docs, shingles.select("h", "k"), id_col, text_col), "places")
    hits = found.select("doc_id", "tie", F.explode("hits").alias("x")).select("doc_id", "tie", "x.*")
    # rarity over all documents; a window's prefix is its rarest shingle
    held = hits.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    ranked = shingles.join(held, "h")
    prefix = ranked.groupBy("window", "len").agg(F.min(F.struct("c", "h", "off")).alias("p")).select("window", "len", "p.h", "p.off")
    start = F.col("at") - F.col("off")
    at = start - F.col("from")
    candidates = _met(hits, prefix, held, windows.count() <= BROADCAST_WINDOWS).where((start >= 0) & (at >= 0) & (at + F.col("len") <= F.size("near")))
    verified = candidates.where(F.array_join(F.slice("near", at + 1, F.col("len")), " ") == F.col("window"))
    matches = materialize(verified.select("doc_id", "tie", start.alias("start"), "len", "window").distinct(), "matches")
    # words covered by the matches of a document, which are no more than it has words, times the lengths of windows
    key = ["doc_id", "tie"]
    spans = matches.select(*key, "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    order = W.partitionBy(*key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(order), F.lit(0))), F.lit(0))
    n_hit = spans.select(*key, fresh.alias("fresh")).groupBy(*key).agg(F.sum("fresh").cast("long").alias("n_hit"))
    per_item = matches.select(*key, "window").distinct().join(windows.select("window", "item_id"), "window").select(*key, "item_id").distinct()
    names = F.array_sort(F.collect_list(F.col("item_id").cast("string")))
    n_items = per_item.groupBy(*key).agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"))
    both = n_hit.join(n_items, [n_hit[c].eqNullSafe(n_items[c]) for c in key]).select(n_hit["doc_id"].alias("__d"), n_hit["tie"].alias("__t"), "n_hit", "n_items", "items_sha256")
    zero = F.lit(0).cast("long")
    out = found.select("doc_id", "tie", "n_words").join(both, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("tie") == F.col("__t")), "left")
    out = out.select(
        "doc_id", "tie", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256")
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, whole; ``contamination`` says how nulls, ties, repeated rows, long texts and empty tables count.

    Columns of any name come through. Of rows that share an id each is judged by its own text. The join is against the few contaminated rows.
    """
    judged = contamination(docs, items, id_col, text_col).where("contaminated")
    bad = judged.select(F.struct(F.col("doc_id").alias("d"), F.col("tie").alias("t")).alias("__bad")).distinct()
    whole = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns))).alias("__r"), F.col(id_col).cast("long").alias("__i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__h"))
    kept = whole.join(bad, F.col("__i").eqNullSafe(F.col("__bad.d")) & (F.col("__h") == F.col("__bad.t")), "left_anti")
    return kept.select(*(F.col(f"__r.k{i}").alias(c) for i, c in enumerate(docs.columns)))
