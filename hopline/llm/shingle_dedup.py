"""Near duplicates by the Jaccard similarity of their shingle sets, for the corpus pipeline.

Candidates come from SimHash: a fingerprint in segments, and each text is indexed under each of its segments and under the variants of the segment with
one zero bit set. So two texts meet where a segment differs by one bit at most. Segments are as wide as the number of texts asks for, so that a key has
some 200 chance rows at most, and as many as it takes for pairs of similarity 0.8 to meet with probability MEET (up to a million texts: eight of 16
bits). What meets and differs by at most some bits more than expected is compared on the shingle sets themselves, and only pairs of similarity LEAST or
more are links.

Only classes count in the end, so a pair within a class needs no comparing. What has a segment in common is looked at first (one key a segment), which
joins much of a dense group: a minimum spanning forest by bits of the pairs under one key and the nearest few of each text are compared. Then everything
is indexed under the variants too, and only pairs between the classes so far are looked at. Where each text has but a few of them, they are compared one
by one; of all other groups, the sets of all texts outside the largest class are compared with those of the whole group, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm.common import give_back
from hopline.llm.simhash import _forest
from hopline.operators.components import connected_components
from hopline.session import discard, materialize, tidy_driver

LEAST, MEET = 0.8, 0.925
#: Probability that a bit differs at similarity LEAST, and standard deviations above the mean up to which candidates may differ.
DIFFERS, DEVIATIONS = math.acos(2 * LEAST / (1 + LEAST)) / math.pi, 2.6
#: Nearest texts under a key that are compared besides the forest; in groups up to this size that is all pairs.
NEAREST = 2
#: Rows of one key that are compared in one go, and pairs that are compared at a time.
BLOCK, PAIRS = 2048, 1 << 20
#: Rows of a large group that wait for a second class to turn up; a group without one needs no comparing.
WAITING = 1 << 18
#: Rows outside the largest class of a group that a block is compared with at a time, and shingles of them.
PART, COLUMNS = 1024, 2048
#: Shingles hashed at a time.
SHINGLES = 1 << 14
#: Texts (keys) up to which the list of those to be verified (gone through again) is broadcast (16 bytes each); beyond, it is joined.
BROADCAST_TEXTS = 250_000


@dataclass(frozen=True)
class Shape:
    """Segments of a fingerprint, and their bits."""

    segments: int
    width: int

    @classmethod
    def of(cls, n_texts: int) -> "Shape":
        width = 16
        while n_texts > 1 << (width + 4):
            width += 4
        hit = (1 - DIFFERS) ** width + width * DIFFERS * (1 - DIFFERS) ** (width - 1)
        return cls(math.ceil(math.log(1 - MEET) / math.log(1 - hit)), width)

    @property
    def bits(self) -> int:
        return self.segments * self.width

    @property
    def words(self) -> int:
        return -(-self.bits // 64)

    @property
    def bound(self) -> int:
        """Bits in which candidates may differ."""
        return round(DIFFERS * self.bits + DEVIATIONS * math.sqrt(self.bits * DIFFERS * (1 - DIFFERS)))


def grams(text: str | None, words_per_shingle: int = 5) -> tuple[int, np.ndarray]:
    """A hash of the words (A-Z lower-cased), and the distinct XXH64 of the shingles; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if not words:
        return 0, np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - words_per_shingle + 1)
    cuts = zip((ends - lengths)[:n].tolist(), ends[-n:].tolist(), strict=True)
    return xxhash.xxh3_64_intdigest(joined), np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b]) for a, b in cuts), np.uint64, n))


def fingerprint(hashes: np.ndarray, shape: Shape) -> np.ndarray:
    """SimHash as u64 words; the bits beyond the shape's are zero."""
    counts = np.zeros(64 * shape.words, np.int64)
    for at in range(0, len(hashes), SHINGLES):
        h = hashes[at : at + SHINGLES]
        drawn = [h]
        for k in range(1, shape.words):
            x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * k + 1)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            drawn.append(x ^ (x >> np.uint64(32)))
        both = np.stack(drawn, axis=1).astype("<u8")
        counts += np.unpackbits(both.view(np.uint8).reshape(-1, 8 * shape.words), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    counts[shape.bits :] = 0
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def _matrix(col: pa.Array, words: int) -> np.ndarray:
    """Binary values of equal size as rows of u64."""
    flat = np.frombuffer(col.buffers()[2], "<u8") if len(col) and col.buffers()[2] is not None else np.zeros(0, "<u8")
    return flat[col.offset * words : (col.offset + len(col)) * words].reshape(-1, words)


def _binary(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * 8
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _prints(words_per_shingle: int, shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, fps = np.zeros(batch.num_rows, np.uint64), np.zeros((batch.num_rows, shape.words), np.uint64)
            for i, text in enumerate(batch.column("text")):
                same[i], found = grams(text.as_py(), words_per_shingle)
                fps[i] = fingerprint(found, shape)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("id"), pa.array(same.view(np.int64)), _binary(fps)], ["k", "id", "s", "f"])
        give_back()

    return run


@dataclass
class Rows:
    """Columns of the index: key, whether a bit of the segment is set, fingerprint, text, class of the text so far."""

    key: np.ndarray
    flip: np.ndarray
    f: np.ndarray
    s: np.ndarray
    c: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch | pa.Table, words: int) -> "Rows":
        col = lambda c: batch.column(c).combine_chunks() if isinstance(batch, pa.Table) else batch.column(c)
        plain = {c: col(c).to_numpy(zero_copy_only=False) for c in ("key", "flip", "s")}
        return cls(**plain, f=_matrix(col("f"), words), c=col("c").to_numpy(zero_copy_only=False) if "c" in batch.schema.names else plain["s"])

    def __len__(self) -> int:
        return len(self.key)

    def at(self, which) -> "Rows":
        return Rows(*(getattr(self, x.name)[which] for x in fields(self)))

    def and_then(self, other: "Rows") -> "Rows":
        return Rows(*(np.concatenate([getattr(r, x.name) for r in (self, other)]) for x in fields(self)))


def _indexed(shape: Shape, variants: bool = True):
    """Rows (s, f), with c if known -> (key, flip, f, s, c): each under its segments and, with ``variants`` and flip 1, under those with one zero bit set."""
    weights, flips = 1 << np.arange(shape.width), np.array([0, *(1 << b for b in range(shape.width) if variants)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                s, f = part.column("s").to_numpy(zero_copy_only=False), _matrix(part.column("f"), shape.words)
                bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(-1, 8 * shape.words), axis=1, count=shape.bits, bitorder="little")
                segments = bits.reshape(-1, shape.segments, shape.width).astype(np.int64) @ weights
                keys = segments[:, :, None] | flips
                take = keys != segments[:, :, None]
                take[:, :, 0] = True
                row, segment, flip = np.nonzero(take)
                key = (segment << shape.width) + keys[row, segment, flip]
                c = part.column("c").to_numpy(zero_copy_only=False) if "c" in part.schema.names else s
                cols = [pa.array(key), pa.array((flip > 0).astype(np.int8)), _binary(f[row]), pa.array(s[row]), pa.array(c[row])]
                yield pa.RecordBatch.from_arrays(cols, ["key", "flip", "f", "s", "c"])

    return run


def _spanning(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the pairs are a minimum spanning forest by bits (Boruvka)."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    weight = bits.astype(np.int64) * len(a) + np.arange(len(a))
    label, chosen = np.arange(len(nodes)), np.zeros(len(a), bool)
    while True:
        alive = np.flatnonzero(label[u] != label[v])
        if not len(alive):
            return chosen
        best = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(best, label[u[alive]], weight[alive])
        np.minimum.at(best, label[v[alive]], weight[alive])
        pick = np.unique(best[best < np.iinfo(np.int64).max]) % len(a)
        chosen[pick] = True
        to = np.arange(len(nodes))
        away, root = _forest(label[u[pick]], label[v[pick]])
        to[away] = root
        label = to[label]


def _nearest(key: np.ndarray, a: np.ndarray, bits: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the ``most`` nearest of their ``a`` under their key."""
    order = np.lexsort((bits, a, key))
    k, x = key[order], a[order]
    starts = np.concatenate([[True], (x[1:] != x[:-1]) | (k[1:] != k[:-1])])
    rank = np.arange(len(a)) - np.maximum.accumulate(np.where(starts, np.arange(len(a)), 0))
    out = np.zeros(len(a), bool)
    out[order] = rank < most
    return out


def _joined(found: list[tuple]) -> tuple[np.ndarray, ...]:
    found = [x for x in found if len(x[0])]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _chosen(found: list[tuple], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b), a < b, to begin with, from the pairs (key, a, b, bits) within the bound: a forest and the nearest of each text."""
    key, a, b, bits = _joined(found)
    if not len(key):
        return a, b
    keep = _nearest(key, a, bits, most) | _nearest(key, b, bits, most) | _spanning(a, b, bits)
    return _distinct(a[keep], b[keep])


def _split(found: list[tuple], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the pairs (key, a, b, bits) within the bound: those of keys under which each text has ``most`` at most (a, b), the other keys, and the texts of their pairs."""
    key, a, b, bits = _joined(found)
    if not len(key):
        return a, b, key, a
    few = _nearest(key, a, bits, most) & _nearest(key, b, bits, most)
    dense = np.unique(key[~few])
    there = np.isin(key, dense)
    return *_distinct(a[~there], b[~there]), dense, np.unique(np.concatenate([a[there], b[there]]))


def _first_segment(x: np.ndarray, shape: Shape, most: int) -> np.ndarray:
    """The first segment in which pairs differ by ``most`` bits at most, from the bits in which they differ (rows of u64)."""
    out = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 1 << 14):
        part = np.ascontiguousarray(x[at : at + (1 << 14)])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8 * shape.words), axis=1, count=shape.bits, bitorder="little")
        out[at : at + len(part)] = (bits.reshape(-1, shape.segments, shape.width).sum(axis=2) <= most).argmax(axis=1)
    return out


def _compare(one: Rows, two: Rows, first: np.ndarray, lo: np.ndarray, hi: np.ndarray, shape: Shape, variants: bool) -> Iterator[tuple]:
    """(key, a, b, bits) of the pairs within the bound of each row ``first`` of ``one`` with rows lo to hi (exclusive) of ``two``; rows of one class, and two flipped ones, are no pair.

    Texts that meet in several segments are a pair in the first of them only, so each pair is seen under one key.
    """
    many = np.maximum(hi - lo, 0)
    ends = np.cumsum(many)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = many[at:to]
        i = np.repeat(first[at:to], n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:to], n)
        ok = np.flatnonzero((one.c[i] != two.c[j]) & ((one.flip[i] == 0) | (two.flip[j] == 0)))
        i, j = i[ok], j[ok]
        bits = np.bitwise_count(one.f[i, 0] ^ two.f[j, 0]).astype(np.int64)
        for w in range(1, one.f.shape[1]):
            bits += np.bitwise_count(one.f[i, w] ^ two.f[j, w])
        near = np.flatnonzero(bits <= shape.bound)
        near = near[_first_segment(one.f[i[near]] ^ two.f[j[near]], shape, int(variants)) == one.key[i[near]] >> shape.width]
        i, j = i[near], j[near]
        yield one.key[i], one.s[i], two.s[j], bits[near]
        at = to


def _within(rows: Rows, shape: Shape, variants: bool) -> list[tuple]:
    """Pairs within whole groups of equal keys; rows are sorted by (key, flip)."""
    first = np.flatnonzero(rows.flip == 0) if (rows.c != rows.c[0]).any() else np.zeros(0, np.int64)
    return list(_compare(rows, rows, first, first + 1, np.searchsorted(rows.key, rows.key[first], "right"), shape, variants))


_MET = "kind byte, a long, b long, key long, flip byte, s long, block int, met boolean"


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Pairs to verify, as kind 0."""
    n = len(a)
    cols = [pa.array(np.zeros(n, np.int8)), pa.array(a), pa.array(b), *(pa.nulls(n, x) for x in (pa.int64(), pa.int8(), pa.int64(), pa.int32(), pa.bool_()))]
    return pa.RecordBatch.from_arrays(cols, ["kind", "a", "b", "key", "flip", "s", "block", "met"])


def _rest(rows: Rows, block: int, met: np.ndarray) -> pa.RecordBatch:
    """Rows of a group that is not done, as kind 1, and whether they may have a pair there."""
    n = len(rows)
    cols = [pa.array(np.ones(n, np.int8)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(rows.key), pa.array(rows.flip), pa.array(rows.s)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(n, block, np.int32)), pa.array(met)], ["kind", "a", "b", "key", "flip", "s", "block", "met"])


def _scanned(shape: Shape, variants: bool = True):
    """Rows sorted by (key, flip) -> pairs, and all rows of the groups that pairs do not settle, by block.

    Without ``variants`` another scan follows: then only pairs come out, of larger groups those within blocks.
    """
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = Rows(none, none.astype(np.int8), np.zeros((0, shape.words), np.uint64), none, none)
        held, big, block = empty, None, 0  # the key whose group has gone out in blocks so far
        alone, waiting = None, []  # the only class of that group so far, and its rows, which no one needs if it stays so

        def small(rows: Rows) -> Iterator[pa.RecordBatch]:
            found = _within(rows, shape, variants)
            if not variants:
                yield _pairs(*_chosen(found, NEAREST))
                return
            a, b, dense, texts = _split(found, NEAREST)
            if len(a):
                yield _pairs(a, b)
            left = rows.at(np.isin(rows.key, dense))
            if len(left):
                yield _rest(left, 0, np.isin(left.s, texts))

        def large(rows: Rows) -> Iterator[pa.RecordBatch]:
            nonlocal big, block, alone, waiting
            if rows.key[0] != big:
                big, block, alone, waiting = int(rows.key[0]), 0, int(rows.c[0]), []
            for at in range(0, len(rows), BLOCK):
                part = rows.at(slice(at, at + BLOCK))
                if not variants:
                    yield _pairs(*_chosen(_within(part, shape, variants), NEAREST))
                    continue
                waiting.append(_rest(part, block, np.ones(len(part), bool)))
                block += 1
                if alone is None or (part.c != alone).any() or len(waiting) * BLOCK > WAITING:
                    yield from waiting
                    alone, waiting = None, []

        def out(rows: Rows) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate([[True], rows.key[1:] != rows.key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(rows)]]))
            wide = (sizes > BLOCK) | (rows.key[starts] == (-1 if big is None else big))
            few = ~np.repeat(wide, sizes)
            if few.any():
                yield from small(rows.at(few))
            for at, n in zip(starts[wide].tolist(), sizes[wide].tolist(), strict=True):
                yield from large(rows.at(slice(at, at + n)))

        for batch in batches:
            if not batch.num_rows:
                continue
            held = held.and_then(Rows.read(batch, shape.words))
            last = int(np.searchsorted(held.key, held.key[-1], "left"))
            if last:
                yield from out(held.at(slice(0, last)))
                held = held.at(slice(last, None))
            if len(held) > BLOCK:  # the last group is larger than a block and may go on
                full = len(held) // BLOCK * BLOCK
                yield from large(held.at(slice(0, full)))
                held = held.at(slice(full, None))
        if len(held):
            yield from out(held)
        give_back()

    return run


def candidates(nodes: DataFrame, shape: Shape, variants: bool) -> tuple[DataFrame, DataFrame]:
    """From ``nodes`` (s, f, c): pairs (a, b) between classes c, a < b, and the rows (key, s, block, met) of groups that these do not settle; both are written."""
    index = nodes.select("s", "f", "c").mapInArrow(_indexed(shape, variants), "key long, flip byte, f binary, s long, c long")
    rows = index.repartition(F.col("key")).sortWithinPartitions("key", "flip")
    found = materialize(rows.mapInArrow(_scanned(shape, variants), _MET), "met")
    pairs = materialize(found.where("kind = 0").select("a", "b").distinct(), "candidates")
    left = found.where("kind = 1").select("key", "s", "block", "met")
    left = materialize(left, "left") if variants else left.limit(0)  # without variants all is settled
    discard(found)
    return pairs, left


def _alike(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Booleans (xs, ys): whether the sets (sorted, distinct) are LEAST or more alike. Intersections are products of 0/1 matrices, some columns at a time."""
    flat, row = [np.concatenate(z) for z in (xs, ys)], [np.repeat(np.arange(len(z)), [len(x) for x in z]) for z in (xs, ys)]
    common = np.intersect1d(*flat)
    both = np.zeros((len(xs), len(ys)), np.float32)
    if len(common):
        at = [np.minimum(np.searchsorted(common, f), len(common) - 1) for f in flat]
        held = [common[p] == f for p, f in zip(at, flat, strict=True)]
        for low in range(0, len(common), COLUMNS):
            sides = []
            for z, p, ok, r in zip((xs, ys), at, held, row, strict=True):
                here = ok & (p >= low) & (p < low + COLUMNS)
                m = np.zeros((len(z), min(COLUMNS, len(common) - low)), np.float32)
                m[r[here], p[here] - low] = 1
                sides.append(m)
            both += sides[0] @ sides[1].T
    sizes = np.array([len(x) for x in xs])[:, None] + np.array([len(y) for y in ys])[None, :]
    return both >= LEAST * (sizes - both)


def _between_classes(table: pa.Table) -> pa.Table:
    """A block of a group with some of the rows outside its largest class -> a forest of the links between classes, as pairs of classes."""
    side, c = table.column("side").to_numpy(), table.column("c").to_numpy()
    sets = [np.frombuffer(g.as_py(), "<u4") for g in table.column("grams")]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not (len(one) and len(two)):
        return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})
    i, j = np.nonzero(_alike([sets[k] for k in one], [sets[k] for k in two]) & (c[one][:, None] != c[two][None, :]))
    src, dst = _forest(c[one][i], c[two][j])
    return pa.table({"src": src, "dst": dst})


def more_links(left: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """From the rows ``left`` (key, s, block) of groups not done and the classes (node, component) so far: links between classes (src, dst), written.

    Of each group the largest class needs no comparing inside. All rows outside it are held against all of the group, a block with some PART of them at a
    time, where their sets are compared at once: no pair is left out, and none but links between classes comes out.
    """
    rows = left.join(classes, F.col("s") == F.col("node"), "left").select("key", "s", "block", F.coalesce("component", "s").alias("c"))
    rows = materialize(rows, "classed")
    size = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"), F.max("block").alias("block"))
    group = size.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"), F.max("block").alias("top"))
    group = materialize(group.where("rest > 0").select("key", "main", F.ceil(F.col("rest") / PART).cast("int").alias("parts"), "top"), "groups")
    hint = F.broadcast if group.count() <= BROADCAST_TEXTS else (lambda x: x)
    dealt = rows.join(hint(group), "key").join(sets, "s")
    one = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(0))
    two = dealt.where("c != main").withColumn("part", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"))
    two = two.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("top")))).withColumn("side", F.lit(1))
    cols = ["key", "block", "part", "c", "side", "grams"]
    out = materialize(one.select(cols).unionByName(two.select(cols)).groupBy("key", "block", "part").applyInArrow(_between_classes, "src long, dst long").distinct(), "links")
    discard(rows)
    discard(group)
    return out


def _sets(words_per_shingle: int):
    """Rows (s, text) -> (s, grams): the sorted low 32 bits of the hashes of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(grams(t.as_py(), words_per_shingle)[1].astype("<u4")).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(sets, pa.binary())], ["s", "grams"])
        give_back()

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (src, dst, x, y) -> a forest of the pairs whose sets are alike."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            p, q = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(both >= LEAST * (len(p) + len(q) - both))
        alike = [batch.column(c).to_numpy(zero_copy_only=False)[np.array(ok, bool)] for c in ("src", "dst")]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(*alike)], ["src", "dst"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs.join(sets.select(F.col("s").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("s").alias("b"), F.col("grams").alias("y")), "b")
    return materialize(both.select(F.col("a").alias("src"), F.col("b").alias("dst"), "x", "y").mapInArrow(_verify, "src long, dst long"), "links")


def _sets_of(wanted: DataFrame, texts: DataFrame, nodes: DataFrame, words_per_shingle: int) -> DataFrame:
    """(s, grams) of the nodes ``wanted`` (s), written."""
    wanted = materialize(wanted.distinct().join(nodes.select("s", "k"), "s"), "wanted")
    hint = F.broadcast if wanted.count() <= BROADCAST_TEXTS else (lambda x: x)
    sets = texts.join(hint(wanted), "k").select("s", "text").mapInArrow(_sets(words_per_shingle), "s long, grams binary")
    sets = materialize(sets.dropDuplicates(["s"]), "sets")
    discard(wanted)
    return sets


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s")))


def _classed(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(found.withColumnRenamed("node", "s"), "s", "left").select("s", "f", F.coalesce("component", "s").alias("c"))


def _grown(found: DataFrame, links: DataFrame) -> DataFrame:
    """The classes ``found`` (node, component), joined by further ``links`` (src, dst), written: only the classes that have a new link go through rounds again."""
    a, b = (found.select(F.col("node").alias(x), F.col("component").alias(f"{x}_class")) for x in ("src", "dst"))
    between = links.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("src_class", "src").alias("src"), F.coalesce("dst_class", "dst").alias("dst"))
    joined = materialize(connected_components(between), "joined")
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = found.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = materialize(old.union(joined.join(found, "node", "left_anti").select("node", "component")), "classes")
    discard(joined)
    return out


def classes(texts: DataFrame, nodes: DataFrame, shape: Shape, words_per_shingle: int = 5) -> DataFrame:
    """(node, component) of the ``nodes`` (s, k, f) that have a link; their texts stand under k in ``texts`` (k, text)."""
    spark = nodes.sparkSession
    pairs, _ = candidates(nodes.withColumn("c", F.col("s")), shape, variants=False)
    sets = _sets_of(_ends(pairs), texts, nodes, words_per_shingle)
    links = _verified(pairs, sets)
    tidy_driver(spark)
    first = connected_components(links)
    tidy_driver(spark)

    more_pairs, left = candidates(_classed(nodes, first), shape, variants=True)
    more_sets = _sets_of(_ends(more_pairs).union(left.where("met").select("s")).join(sets, "s", "left_anti"), texts, nodes, words_per_shingle)
    both = sets.union(more_sets)
    new_links = _verified(more_pairs, both)
    tidy_driver(spark)
    out = _grown(first, new_links)
    if not left.isEmpty():
        tidy_driver(spark)
        last = more_links(left, out, both)
        tidy_driver(spark)
        before, out = out, _grown(out, last)
        discard(before)
        discard(last)
    for df in (pairs, sets, links, more_pairs, left, more_sets, new_links):
        discard(df)
    return out


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, shape: Shape | None = None) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class, one row with the smallest id (a null id only where there is no other).

    A class is connected by pairs of similarity LEAST or more. Null, empty and blank texts are copies of each other, and so are texts of the same words.
    A row is known by a hash of its id and text, not by its place in the input, so it does not matter how a later job splits the files; of rows that
    share both, one stays. An empty table gives an empty result, and columns of any name come through. Texts are shuffled for the last semi-join only,
    and those to be verified as sets.
    """
    shape = shape or Shape.of(docs.count())
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("k")
    texts = docs.select(key, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"k long, id {texts.schema['id'].dataType.simpleString()}, s long, f binary"
    prints = materialize(texts.mapInArrow(_prints(words_per_shingle, shape), schema), "prints")
    nodes = materialize(prints.groupBy("s").agg(F.min("k").alias("k"), F.first("f").alias("f")), "nodes")
    roots = classes(texts, nodes, shape, words_per_shingle)
    rooted = prints.join(roots.withColumnRenamed("node", "s"), "s", "left").select("k", "id", F.coalesce("component", "s").alias("root"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "k")).alias("m"))
    best = materialize(best.select(F.col("m.k").alias("__k")), "best")
    discard(prints)
    discard(nodes)
    whole = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns))).alias("__r"), key.alias("__k"))
    kept = whole.join(best, "__k", "left_semi").dropDuplicates(["__k"])
    return kept.select(*(F.col(f"__r.k{i}").alias(c) for i, c in enumerate(docs.columns)))
