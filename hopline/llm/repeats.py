"""Removal of repeated byte strings by a column-wise multi-document construction.

The construction puts one symbol of each document in front of its suffix a round, and updates the order of the suffixes (by the symbols of the
collection's Burrows-Wheeler transform: a stable sort of the last order by the new symbol) and the common prefixes of neighbours. Over whole texts it
would need as many rounds as the longest text has bytes, each a pass over the collection. So texts are first cut where they can meet at all:

1. Every window of LENGTH bytes has an anchor, the least hash of its GRAM-byte strings. Starts with one anchor form a region. Windows that are equal have
   equal anchors at equal places, so windows need comparing only between regions with one anchor string, laid over each other at the anchor.
2. A region whose whole context (all bytes of its windows) occurs twice repeats as a whole; copies are counted, not compared.
3. Where an anchor has several contexts, one of each goes through the construction, in rounds from the last column to the first. A window that begins at
   the column just inserted is repeated where the common prefix with a neighbour in the order is LENGTH or more. Columns are read in sequence from one
   buffer of the task, of bounded size.
4. An anchor with more than MOST contexts does not go into one task: its windows are hashed (128 bits) and counted with map-side aggregates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm.common import with_row_key
from hopline.session import discard, materialize

LENGTH, GRAM = 400, 128
#: Contexts of an anchor that one task orders, contexts and bytes of a batch of anchors, and starts of a text that are looked at in one go.
MOST, BATCH, STEP = 1 << 15, 1 << 13, 1 << 20

_CONTEXT = "fp long, c long, row long, s0 int, n int, off int"
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(4096, 1 << (n - 1).bit_length())
    if size not in _powers:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[size] = tables[0], tables[1]
    return _powers[size]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram``-byte string of ``data``."""
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    n = len(data) - gram + 1
    h = (sums[gram:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def regions(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(first start, number of starts, anchor - first start, anchor hash) of the regions of a text, for STEP starts at a time."""
    whole = np.frombuffer(text, np.uint8)
    place = np.uint64((1 << 24) - 1)
    for at in range(0, len(whole) - length + 1, STEP):
        data = whole[at : at + STEP + length - 1]
        h = gram_hashes(data, gram)
        least = _sliding_min((h & ~place) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        anchor = (least & place).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        a = anchor[first]
        yield at + first, np.diff(np.concatenate([first, [len(anchor)]])), a - first, h[a].view(np.int64)


def find_regions(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each region; c is a hash of its whole context and of where the anchor stands in it. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            size = 0
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                data = text.as_py()
                for s0, n, off, fp in regions(data, length, gram):
                    context = [xxhash.xxh3_64_intdigest(data[a : a + k + length - 1], o) for a, k, o in zip(s0.tolist(), n.tolist(), off.tolist(), strict=True)]
                    for col, x in zip(cols, (fp, np.array(context, np.uint64).view(np.int64), np.full(len(fp), row), s0, n, off), strict=True):
                        col.append(x)
                    size += len(fp)
                if size > 100_000:
                    yield _batch(cols, _CONTEXT)
                    cols, size = [[], [], [], [], [], []], 0
            if size:
                yield _batch(cols, _CONTEXT)

    return keyed.select("row", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= length).mapInArrow(run, _CONTEXT)


def _batch(cols: list[list[np.ndarray]], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _least(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of x[low..high], ends included, for many ranges: of two runs of a power of two that cover it."""
    out, size = x[low], high - low + 1
    runs, k = x, 1
    while (at := np.flatnonzero(size >= 2 * k)).size:
        runs = np.minimum(runs[: len(runs) - k], runs[k:])  # of 2k each
        k *= 2
        out[at] = np.minimum(runs[low[at]], runs[high[at] - k + 1])
    return out


def repeated_starts(groups: np.ndarray, contexts: list[bytes], offs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, whether the window at each of its starts is also a window of another context of its group.

    Contexts of a group (equal numbers, adjacent) are aligned at their anchors, which stand at ``offs``. One round a column, from the right.
    """
    m = len(contexts)
    sizes = np.array([len(c) for c in contexts], np.int64)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.cumsum(sizes) - sizes + offs  # where the anchor stands
    left, right = -offs, sizes - offs
    order = np.arange(m)
    prefix = np.zeros(m + 1, np.int64)  # prefix[k]: of the suffixes at places k - 1 and k of the order; 0 at both ends
    major = groups.astype(np.int64) * 512
    out = [np.zeros(s - length + 1, bool) for s in sizes]
    hits_i, hits_at = [], []
    for col in range(int(right.max()) - 1, int(left.min()) - 1, -1):
        inside = (col >= left) & (col < right)
        symbol = np.zeros(m, np.int64)  # 0: the context has no byte here, and shares no prefix
        symbol[inside] = flat[base[inside] + col].astype(np.int64) + 1
        key = major + symbol[order]
        perm = np.argsort(key, kind="stable")
        same = np.zeros(m + 1, bool)
        ordered = key[perm]
        same[1:m] = (ordered[1:] == ordered[:-1]) & ((ordered[1:] & 511) > 0)
        at = np.flatnonzero(same)
        value = _least(prefix, perm[at - 1] + 1, perm[at])  # between the two places of the last order
        prefix = np.zeros(m + 1, np.int64)
        prefix[at] = value + 1
        order = order[perm]
        long = prefix >= length
        if long.any():
            hit = order[long[:m] | long[1:]]
            hits_i.append(hit)
            hits_at.append(np.full(len(hit), col))
    for i, at in zip(hits_i, hits_at, strict=True):
        for k, c in zip(i.tolist(), (at - left[i]).tolist(), strict=True):
            out[k][c] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


_VERDICT = "fp long, c long, first int, many int"


def _construct(length: int):
    """Rows (fp, c, off, context) sorted by fp -> the runs of repeated starts of each context."""

    def decide(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        fps = np.array([r[0] for r in rows], np.int64)
        groups = np.concatenate([[0], np.cumsum(fps[1:] != fps[:-1])])
        found = repeated_starts(groups, [r[3] for r in rows], np.array([r[2] for r in rows], np.int64), length)
        said = [(r[0], r[1], a, n) for r, flags in zip(rows, found, strict=True) for a, n in _runs(flags)]
        if said:
            yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in said], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["fp", "c", "first", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("fp", "c", "off", "context")), strict=True):
                if len(rows) >= BATCH and row[0] != rows[-1][0]:
                    yield from decide(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from decide(rows)

    return run


def _hash_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, c, context in zip(*(batch.column(x).to_pylist() for x in ("fp", "c", "context")), strict=True):
                n = len(context) - length + 1
                w = [xxhash.xxh3_128_digest(context[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array([fp] * n, pa.int64()), pa.array([c] * n, pa.int64()), pa.array(range(n), pa.int32())], ["w", "fp", "c", "at"])

    return run


def _cut_contexts(length: int):
    """Rows (text, wanted) -> (fp, c, off, many, context) for each wanted region of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                data, want = text.as_py(), wanted.as_py()
                cols = [[w[k] for w in want] for k in ("fp", "c", "off", "many")] + [[data[w["s0"] : w["s0"] + w["n"] + length - 1] for w in want]]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["fp", "c", "off", "many", "context"])

    return run


def repeated_runs(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(row, first, many): runs of starts in each row's text whose windows of ``length`` bytes also start anywhere else. ``keyed``: (row, text)."""
    found = materialize(find_regions(keyed, length, gram), "regions")
    classes = found.groupBy("fp", "c").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "s0", "n", "off")).alias("one"))
    anchors = classes.groupBy("fp").agg(F.count(F.lit(1)).alias("many"), F.min("copies").alias("fewest"), F.max("copies").alias("top"))
    anchors = anchors.where("many > 1 OR top > 1")
    live = materialize(classes.join(anchors, "fp").select("fp", "c", "copies", "one", "many", "fewest"), "classes")
    whole = live.where("copies > 1").select("fp", "c", F.lit(0).alias("first"), F.col("one.n").alias("many"))
    # where each context of an anchor has copies, all is said
    wanted = live.where("many > 1 AND fewest = 1").groupBy(F.col("one.row").alias("r")).agg(
        F.collect_list(F.struct("fp", "c", F.col("one.s0").alias("s0"), F.col("one.n").alias("n"), F.col("one.off").alias("off"), "many")).alias("wanted")
    )
    texts = keyed.select("row", F.col("text").cast("binary").alias("text"))
    cut = texts.join(wanted, F.col("row") == F.col("r")).select("text", "wanted").mapInArrow(_cut_contexts(length), "fp long, c long, off int, many long, context binary")
    cut = materialize(cut, "contexts")
    few = cut.where(F.col("many") <= most).select("fp", "c", "off", "context").repartition(F.col("fp")).sortWithinPartitions("fp", "c")
    built = few.mapInArrow(_construct(length), _VERDICT)
    windows = cut.where(F.col("many") > most).select("fp", "c", "context").mapInArrow(_hash_windows(length), "w binary, fp long, c long, at int")
    twice = windows.groupBy("w").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("w")
    hashed = windows.join(twice, "w").select("fp", "c", F.col("at").alias("first"), F.lit(1).alias("many"))
    parts = materialize(built.union(hashed), "parts").join(whole.select("fp", "c"), ["fp", "c"], "left_anti")
    verdicts = materialize(whole.union(parts), "verdicts")
    discard(cut)
    out = found.join(verdicts, ["fp", "c"]).select("row", (F.col("s0") + F.col("first")).alias("first"), "many")
    return out


def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True):
                data, spans, end = text.as_py() or b"", [], -1
                for first, many in sorted((r["first"], r["many"]) for r in runs or ()):
                    stop = first + many + length - 1
                    if first <= end:
                        spans[-1][1] = end = max(end, stop)
                    else:
                        spans.append([first, stop])
                        end = stop
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                for col, x in zip(cols, (len(data), left, len(data) - len(left), len(spans)), strict=True):
                    col.append(x)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            sums = pa.array([hashlib.sha256(x).hexdigest() for x in cols[1]], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays, sums], ["doc_id", "n_bytes", "kept", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", gram: int | None = None, most: int = MOST) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, kept (the remaining bytes), n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in its own text too; strings
    are judged on the input. Texts shorter than that stay. Rows that share an id count as different documents, so repeated rows of ``length`` bytes or
    more lose all; a null id stays null; other columns are ignored; an empty table gives an empty result. What remains may cut a UTF-8 character where
    the strings do. The numbered rows are written once, as a number taken from a scan changes with how a later job splits the files.
    """
    keyed = materialize(with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "row"), "keyed")
    runs = repeated_runs(keyed.select("row", "text"), length, gram or max(1, length * GRAM // LENGTH), most)
    per_row = runs.groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct("first", "many")).alias("runs"))
    joined = keyed.select("row", "doc_id", F.col("text").cast("binary").alias("text")).join(per_row, F.col("row") == F.col("r"), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(_strip(length), "doc_id long, n_bytes long, kept binary, n_removed long, n_spans long, kept_sha256 string")
