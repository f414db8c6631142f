"""SimHash near-dedup by deletion variants.

Fingerprints of 64 bits link at 3 or fewer differing bits. Cut into two halves of 32, one half differs by at most one bit. So each distinct
fingerprint is indexed, for each half, under the half itself and under its 32 one-wildcard variants; fingerprints that link meet under an equal key,
where the whole 64 bits are compared. From each group of equal keys only a spanning forest of its links comes out, never all pairs, and the
components of those links are found on the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.operators.components import connected_components
from hopline.session import discard, materialize

MAX_DIFFERENT = 3
#: Fingerprints of one key that are compared in one go; a larger group is cut into blocks of this size, and each pair of blocks is a group of its own.
BLOCK = 2048
#: Groups up to this size are compared pair by pair in step with all others of the batch.
SMALL = 32
#: Shingles hashed at a time.
SHINGLES = 1 << 16


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the whole text: bit k is 1 if it is set in over half the XXH64 of the shingles (A-Z lower-cased, white space of ASCII cut)."""
    words = (text or "").encode().lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - words_per_shingle + 1)
    last = ends[-n:]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES):
        cuts = zip(starts[at : min(n, at + SHINGLES)].tolist(), last[at : at + SHINGLES].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in cuts], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words_per_shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def variants(nodes: DataFrame) -> DataFrame:
    """(key, fp): 66 rows for each fingerprint. A key is half (0, 1), wildcard (0 to 31, 32 for none) and the 32 bits without the wildcard."""
    keys = []
    for half in (0, 1):
        bits = F.expr(f"shiftrightunsigned(fp, {32 * half}) & 4294967295L")
        for wild in range(33):
            left = bits.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << wild))) if wild < 32 else bits
            keys.append(F.lit((half * 33 + wild) << 32) + left)
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _near(a: np.ndarray, b: np.ndarray, wild: np.ndarray) -> np.ndarray:
    """Whether a and b link by this key: at most 3 bits differ, and under a wildcard the wildcard bit does (else they meet under the whole half)."""
    x = a ^ b
    return (np.bitwise_count(x) <= MAX_DIFFERENT) & ((wild == 0) | ((x & wild) != 0))


def _wild_bit(key: np.ndarray) -> np.ndarray:
    kind = (key >> 32).astype(np.int64)
    half, wild = kind // 33, kind % 33
    return np.where(wild < 32, np.uint64(1) << (half * 32 + wild % 32).astype(np.uint64), np.uint64(0))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star to the first member of each component of the pairs (a, b)."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (nxt := new[new]).tobytes() != new.tobytes():
            new = nxt
        if (new == label).all():
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def _links_within(fps: np.ndarray, wild: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among up to BLOCK fingerprints."""
    return _links_between(fps, fps, wild)


def _links_between(a: np.ndarray, b: np.ndarray, wild: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    us, vs = [a[:0]], [a[:0]]
    for at in range(0, len(a), 256):
        part = a[at : at + 256]
        i, j = np.nonzero(_near(part[:, None], b[None, :], np.full((1, 1), wild, np.uint64)))
        u, v = part[i], b[j]
        differ = u != v
        u, v = _forest(u[differ], v[differ])
        us.append(u)
        vs.append(v)
    return _forest(np.concatenate(us), np.concatenate(vs))


def _group_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links in whole groups of equal keys, each of at most BLOCK rows; rows are sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    us, vs = [], []
    size_at = np.repeat(sizes, sizes)
    at = np.flatnonzero((size_at > 1) & (size_at <= SMALL))
    for step in range(1, SMALL):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        ok = at[_near(fp[at], fp[at + step], _wild_bit(key[at]))]
        us.append(fp[ok])
        vs.append(fp[ok + step])
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        u, v = _links_within(fp[s : s + n], _wild_bit(key[s : s + 1])[0])
        us.append(u)
        vs.append(v)
    return _forest(np.concatenate(us), np.concatenate(vs)) if us else (fp[:0], fp[:0])


def _rows(kind: int, a: np.ndarray, b: np.ndarray, block: np.ndarray | int = 0) -> pa.RecordBatch:
    blocks = np.broadcast_to(np.asarray(block, np.int64), a.shape)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.ascontiguousarray(blocks))], ["kind", "a", "b", "block"]
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> kind 0: links (a, b); kind 1: (key, fp, block) of groups that are larger than a block."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    big, block = None, 0  # the key whose group has gone out in blocks so far

    def flush(upto: int) -> Iterator[pa.RecordBatch]:
        nonlocal key, fp
        if upto:
            u, v = _group_links(key[:upto], fp[:upto])
            key, fp = key[upto:], fp[upto:]
            if len(u):
                yield _rows(0, u, v)

    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        while len(key):
            if big is not None:  # more of the group that is too large for one block
                n = int(np.searchsorted(key, big, "right"))
                if n == len(key) and n < BLOCK:
                    break
                part = fp[: min(n, BLOCK)]
                if len(part):
                    u, v = _links_within(part, _wild_bit(np.array([big]))[0])
                    yield _rows(0, u, v)
                    yield _rows(1, np.full(len(part), big), part, block)
                if n <= BLOCK and n < len(key):  # another key follows
                    big = None
                key, fp, block = key[len(part) :], fp[len(part) :], block + 1
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            over = np.flatnonzero(sizes > BLOCK)
            if len(over):
                yield from flush(int(starts[over[0]]))
                big, block = int(key[0]), 0
                continue
            yield from flush(int(starts[-1]))  # the last group may go on in the next batch
            break
    if big is not None and len(key):
        n = int(np.searchsorted(key, big, "right"))
        u, v = _links_within(fp[:n], _wild_bit(np.array([big]))[0])
        yield _rows(0, u, v)
        yield _rows(1, np.full(n, big), fp[:n], block)
        key, fp = key[n:], fp[n:]
    yield from flush(len(key))


def _pair_of_blocks(args: tuple, table: pa.Table) -> pa.Table:
    key, one, two = (x.as_py() for x in args)
    fp, block = table.column("fp").to_numpy().view(np.uint64), table.column("block").to_numpy()
    u, v = _links_between(fp[block == one], fp[block == two], _wild_bit(np.array([key]))[0])
    return pa.table({"src": pa.array(u.view(np.int64)), "dst": pa.array(v.view(np.int64))})


def links(nodes: DataFrame) -> DataFrame:
    """(src, dst): a forest, for each group of equal keys, of the links between distinct fingerprints ``nodes`` (fp)."""
    rows = variants(nodes).repartition(F.col("key")).sortWithinPartitions("key", "fp")
    found = materialize(rows.mapInArrow(_scan, "kind int, a long, b long, block long"), "links")
    near = found.where("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    wide = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"), "block")
    if wide.isEmpty():
        return near
    # each row of a large group goes to the pairs of its block with every other one
    n = wide.groupBy("key").agg((F.max("block") + 1).alias("n"))
    dealt = wide.join(n, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).where("other != block")
    pairs = dealt.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "fp", "block")
    return near.union(pairs.groupBy("key", "one", "two").applyInArrow(_pair_of_blocks, "src long, dst long"))


def fingerprint_classes(fps: DataFrame) -> DataFrame:
    """(fp, component_id): for each distinct fp of (doc_id, fp), the smallest doc_id of its class; null only where all ids of a class are."""
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(links(nodes.select("fp")))
    rooted = materialize(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "roots")
    discard(nodes)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Texts of fewer words than a shingle are one shingle; null, empty and blank texts have fingerprint zero and link like any other. Rows that share
    an id are fingerprinted each for itself; a null id joins its class but does not name it. An empty table gives an empty result; other columns are
    ignored. Equal fingerprints are one node, so a large group of copies costs a row each and one join, which AQE splits where it is skewed.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words_per_shingle), "fps")
    out = fps.join(fingerprint_classes(fps), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` without near duplicates by the similarity of their shingle sets; see ``shingle_dedup``."""
    from hopline.llm import shingle_dedup  # it uses this module

    return shingle_dedup.keep_one_of_each(docs, id_col, text_col, words_per_shingle)
