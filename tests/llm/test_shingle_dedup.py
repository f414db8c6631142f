"""The pipeline's near-dedup against the Jaccard similarity of five-word shingles."""

import os
import random
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents  # noqa: E402

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pytest  # noqa: E402

from hopline.llm import shingle_dedup, simhash  # noqa: E402

BANDS = [(0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0)]


def shingles(text):
    words = text.split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def near_pairs(each, seed=3):
    """Pairs of texts of 100 to 400 words with scattered edits, so many for each band of similarity, and for 0.5 to 0.75."""
    rnd, out = random.Random(seed), []
    for low, high in [*BANDS, (0.5, 0.75)]:
        n = 0
        while n < each:
            words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(100, 400))]
            other = list(words)
            for _ in range(rnd.randint(1, max(1, len(words) // 12))):
                other[rnd.randrange(len(other))] = f"e{rnd.randrange(5000)}"
            a, b = " ".join(words), " ".join(other)
            if low <= jaccard(a, b) < high:
                out.append((low, a, b))
                n += 1
    return out


def test_recall_by_band_and_no_false_pairs(spark):
    pairs = near_pairs(int(os.environ.get("NEAR_PAIRS", "60")))
    docs = [(2 * i + k, t, "en", "a") for i, (_, *ab) in enumerate(pairs) for k, t in enumerate(ab)]
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(documents(spark, docs)).select("doc_id").collect()}
    assert all(2 * i in kept for i in range(len(pairs)))
    found = {}
    for i, (low, *_) in enumerate(pairs):
        found.setdefault(low, []).append(2 * i + 1 not in kept)
    print({low: round(sum(f) / len(f), 3) for low, f in found.items()})
    assert not any(found.pop(0.5))
    assert all(sum(f) / len(f) >= 0.85 for f in found.values()), found


def test_wider_segments_for_more_texts(spark):
    assert [shingle_dedup.Shape.of(n) for n in (0, 1 << 20, 1 << 21, 1 << 25)] == [shingle_dedup.Shape(*x) for x in ((8, 16), (8, 16), (14, 20), (24, 24))]
    pairs = near_pairs(20)
    docs = documents(spark, [(2 * i + k, t, "en", "a") for i, (_, *ab) in enumerate(pairs) for k, t in enumerate(ab)])
    kept = {r["doc_id"] for r in shingle_dedup.keep_one_of_each(docs, shape=shingle_dedup.Shape(14, 20)).select("doc_id").collect()}
    near = [i for i, (low, *_) in enumerate(pairs) if low > 0.5]
    assert sum(2 * i + 1 not in kept for i in near) >= 0.9 * len(near) and all(2 * i + 1 in kept for i in range(len(pairs)) if i not in near)


def dense_texts(n=150):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(3000)}" for _ in range(200)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randrange(6)):
            words[rnd.randrange(200)] = f"e{rnd.randrange(9)}"
        out.append(" ".join(words))
    return out


def joined(nodes, links):
    """node -> the least node of its class."""
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def true_classes(texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return len(set(joined(range(len(texts)), links).values()))


def true_classes_of(sets):
    return joined(sets, [(a, b) for a in sets for b in sets if a < b and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))])


def classes_of_all_that_meet(index, sets, fps, shape):
    groups = {}
    for r in index.to_pylist():
        groups.setdefault(r["key"], []).append((r["s"], r["flip"]))
    met = {(a, b) for g in groups.values() for a, x in g for b, y in g if a < b and not (x and y)}
    bits = lambda a, b: int(np.bitwise_count(fps[a] ^ fps[b]).sum())
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    return joined(sets, [p for p in met if bits(*p) <= shape.bound and alike(*p)])


@pytest.mark.parametrize("block,nearest", [(2048, 64), (16, 8), (2048, 1), (16, 1), (3, 2)])
def test_dense_groups_are_whole(spark, monkeypatch, block, nearest):
    """Whatever is compared first, no link of a group is lost: the classes are those of all pairs that meet."""
    texts = dense_texts()
    nodes = sorted({int(np.uint64(s).view(np.int64)): h for s, h in map(shingle_dedup.grams, texts)}.items())
    shape = shingle_dedup.Shape(8, 16)
    fps = np.array([shingle_dedup.fingerprint(h, shape) for _, h in nodes])
    batch = pa.RecordBatch.from_arrays([pa.array([s for s, _ in nodes]), shingle_dedup._binary(fps)], ["s", "f"])
    index = pa.Table.from_batches(list(shingle_dedup._indexed(shape)(iter([batch])))).sort_by([("key", "ascending"), ("flip", "ascending")])
    monkeypatch.setattr(shingle_dedup, "BLOCK", block)
    monkeypatch.setattr(shingle_dedup, "NEAREST", nearest)
    for size in (7, 50, 10_000):  # batches that cut groups anywhere
        met = pa.Table.from_batches(list(shingle_dedup._scanned(shape)(iter(index.to_batches(max_chunksize=size))))).to_pylist()
        gone = [(r["key"], r["flip"], r["s"]) for r in met if r["kind"] == 1]
        sizes = Counter(index.column("key").to_pylist())
        assert len(gone) == len(set(gone)) and {k for k, *_ in gone} >= {k for k, n in sizes.items() if n > block}
        assert all(n == sizes[k] for k, n in Counter(k for k, *_ in gone).items())
    pairs = pa.Table.from_batches(list(shingle_dedup._scanned(shape)(iter(index.to_batches()))))
    # the second round, from what the first has left
    sets, met = dict(nodes), pairs.to_pylist()
    found = [(r["a"], r["b"]) for r in met if r["kind"] == 0]
    first = joined(sets, [(a, b) for a, b in found if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))])
    left = spark.createDataFrame([(r["key"], r["s"], r["block"]) for r in met if r["kind"] == 1], "key long, s long, block int")
    grams = spark.createDataFrame([(s, bytearray(np.unique(h.astype("<u4")).tobytes())) for s, h in nodes], "s long, grams binary")
    monkeypatch.setattr(shingle_dedup, "PART", 5)
    more = shingle_dedup.more_links(left, spark.createDataFrame(list(first.items()), "node long, component long"), grams)
    root = joined(sets, list(first.items()) + [(r["src"], r["dst"]) for r in more.collect()])
    least, most = classes_of_all_that_meet(index, sets, dict(zip(sets, fps)), shape), true_classes_of(sets)
    assert len({(root[s], least[s]) for s in sets}) == len(set(least.values()))  # each class of pairs that meet is in one
    assert len({(root[s], most[s]) for s in sets}) == len(set(root.values()))  # and each of these in a true one


def test_rounds_through_spark(spark):
    """300 texts around one base and as many around another that has half of its words."""
    texts = dense_texts(300) + [t.replace("w1", "v1").replace("w2", "v2") for t in dense_texts(300)]
    kept = shingle_dedup.keep_one_of_each(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]))
    least = true_classes(sorted(set(texts)))
    assert least <= kept.count() <= least + 3
    assert shingle_dedup.keep_one_of_each(documents(spark, [])).count() == 0
    clash = documents(spark, [(1, "a b c d e f", "en", "a"), (2, "A b c d e f", "en", "a")]).selectExpr("*", "1 AS k", "2 AS s", "3 AS f", "4 AS root", "5 AS __k")
    assert [(r["doc_id"], r["k"], r["root"]) for r in shingle_dedup.keep_one_of_each(clash).collect()] == [(1, 1, 4)]


def test_classes_grow_by_further_links_only(spark, monkeypatch):
    """Further links join the classes so far as a search over all links does, but go through it as links between classes."""
    rnd = random.Random(5)
    edges = [(rnd.randrange(-400, 400), rnd.randrange(-400, 400)) for _ in range(500)]
    frame = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    rows = lambda df: {(r["node"], r["component"]) for r in df.collect()}
    whole = rows(shingle_dedup.connected_components(frame(edges)))
    first = shingle_dedup.connected_components(frame(edges[:300]))
    classes, seen, search = dict(rows(first)), [], shingle_dedup.connected_components
    monkeypatch.setattr(shingle_dedup, "connected_components", lambda links: search((seen.append(links), links)[1]))
    out = shingle_dedup._grown(shingle_dedup._grown(first, frame(edges[300:400])), frame(edges[400:]))
    assert rows(out) == whole and out.count() == len(whole)
    assert {n for r in seen[0].collect() for n in r} <= set(classes.values()) | {n for e in edges[300:400] for n in e if n not in classes}
    assert rows(shingle_dedup._grown(first, frame([]))) == rows(first)


def test_driver_returns_memory(spark):
    from hopline.session import tidy_driver

    runtime, system = spark._jvm.java.lang.Runtime.getRuntime(), spark._jvm.java.lang.System
    used = lambda: runtime.totalMemory() - runtime.freeMemory()
    for _ in range(20):
        system.getProperty("hopline.none", "x" * (1 << 20))  # leaves garbage behind
    before = used()
    tidy_driver(spark)
    assert used() < before - (20 << 20)
