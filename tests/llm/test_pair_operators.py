"""Operators 5, 7 and 8 against brute force."""

import hashlib
import os
import random
import re
import sys

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents, rows, table  # noqa: E402

from hopline.llm import decontaminate, repeats, simhash  # noqa: E402


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps, ids):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One TWO", "a b c", "É é  x\xa0y z", "w " * 200_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_near_duplicates(spark):
    docs = table(150, most=25) + [(None, "a b c d", "en", "a"), (3, "a b c d", "en", "a"), (3, "a b c d", "en", "a")]
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(3000)}" for _ in range(300)]
    for i in range(60):
        words = list(base)
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(300)] = "edit"
        docs.append((1000 + i, " ".join(words), "en", "a"))
    fps = [brute_fingerprint(t) for _, t, *_ in docs]
    want = sorted(((str(d), f"{f:016x}", c) for (d, *_), f, c in zip(docs, fps, brute_classes(fps, [d for d, *_ in docs]))), key=str)
    got = sorted(((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in rows(simhash.near_duplicates(documents(spark, docs)))), key=str)
    assert got == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def dense(n, seed=3):
    """Fingerprints around a few centres, so that groups of one key are large, and some alone."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(3)]
    out = set()
    while len(out) < n:
        x = rnd.choice(centres) if rnd.random() < 0.9 else rnd.getrandbits(64)
        for _ in range(rnd.randrange(5)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("block,batch", [(2048, 10_000), (16, 7), (40, 100), (3, 1000)])
def test_links_of_large_groups(spark, monkeypatch, block, batch):
    """Groups beyond a block go through pairs of blocks; with all of it in one process the sizes can be set."""
    import pyarrow as pa

    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = dense(400)
    keyed = []
    for f in fps:
        for half in (0, 1):
            v = f >> 32 * half & 0xFFFFFFFF
            keyed += [((half * 33 + w) << 32 | (v & ~(1 << w) if w < 32 else v), f) for w in range(33)]
    keyed.sort()
    key, fp = np.array([k for k, _ in keyed], np.int64), np.array([f for _, f in keyed], np.uint64).view(np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + batch]), pa.array(fp[i : i + batch])], ["key", "fp"]) for i in range(0, len(key), batch)]
    edges, wide = [], {}
    for b in simhash._scan(iter(batches)):
        for kind, x, y, block_id in zip(*(c.to_pylist() for c in b.columns)):
            if kind == 0:
                edges.append((x, y))
            else:
                wide.setdefault(x, []).append((y, block_id))
    for k, members in wide.items():
        n = max(b for _, b in members) + 1
        for one in range(n):
            for two in range(one + 1, n):
                t = pa.table({"fp": pa.array([f for f, b in members if b in (one, two)]), "block": pa.array([b for _, b in members if b in (one, two)])})
                out = simhash._pair_of_blocks((pa.scalar(k), pa.scalar(one), pa.scalar(two)), t)
                edges += zip(out.column("src").to_pylist(), out.column("dst").to_pylist())
    assert not wide if block > 100 else wide or block > 16
    assert all(((a ^ b) & (2**64 - 1)).bit_count() for a, b in edges)
    parent = {f: f for f in np.array(fps, np.uint64).view(np.int64).tolist()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    got = {}
    for f in parent:
        got.setdefault(root(f), set()).add(f & (2**64 - 1))
    want = {}
    for f, c in zip(fps, brute_classes(fps, fps)):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_links_through_spark_with_blocks(spark, monkeypatch):
    fps = dense(300)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in rows(simhash.fingerprint_classes(df))}
    assert [got[f] for f in signed] == brute_classes(fps, list(range(len(fps))))


def test_keep_one_of_each(spark):
    docs = [(5, "a b c d e f", "en", "a"), (2, "A B C D E F", "en", "b"), (2, "A B C D E F", "en", "b"), (None, "a b c d e f", "en", "a"), (9, "other words stand here now", "en", "a"), (None, "a lone text without any id", "en", "a")]
    kept = simhash.keep_one_of_each(documents(spark, docs))
    assert kept.columns == documents(spark, docs).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "9", "None"]


def brute_repeats(texts, length):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = 1
        gone[-1] = 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts(seed, n=60, length=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rnd.randint(6, 40))) for _ in range(6)]
    texts = [None, "", "x" * (length - 1), "x" * length, "y" * (3 * length), "ab" * length, passages[0], passages[0]]
    while len(texts) < n:
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30))) for _ in range(3)]
        t = parts[0] + rnd.choice(passages)[rnd.randrange(20) :] + parts[1] + rnd.choice([*passages, ""])[: rnd.randrange(30, 200)] + parts[2]
        texts.append(t)
        if rnd.random() < 0.3:  # a near copy
            k = rnd.randrange(len(t))
            texts.append(t[:k] + "!" + t[k + 1 :])
    return texts


@pytest.mark.parametrize("most", [256, 3])
def test_remove_repeats(spark, most):
    texts = repeated_texts(1)
    docs = [(None if i == 9 else i // 2 if i < 8 else i, t, "en", "a") for i, t in enumerate(texts)]
    df = documents(spark, docs).drop("n")  # a clash is tested below
    out = rows(repeats.remove_repeats(df, length=40, gram=12, most=most))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out)
    assert got == sorted((str(d), *w) for (d, *_), w in zip(docs, brute_repeats(texts, 40)))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out)


def test_remove_repeats_clashing_names_and_empty_table(spark):
    docs = documents(spark, [(1, "q" * 900, "en", "a"), (2, "r", "en", "a")]).selectExpr("*", "1 AS row", "2 AS fp2", "3 AS first")
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows(repeats.remove_repeats(docs))) == [(1, 0, 0), (900, 900, 1)]
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("step", [1 << 20, 37])
@pytest.mark.parametrize("gram", [1, 7, 20])
def test_regions_and_construction_in_one_process(monkeypatch, step, gram):
    monkeypatch.setattr(repeats, "STEP", step)
    length, texts = 20, [(t or "").encode() for t in repeated_texts(2, 30, 20)]
    found = [(fp, i, s, n, o) for i, t in enumerate(texts) for a in repeats.regions(t, length, gram) for s, n, o, fp in zip(*(x.tolist() for x in a))]
    for i, t in enumerate(texts):  # regions cover each start once
        assert sorted(x for _, j, s, n, _ in found if j == i for x in range(s, s + n)) == list(range(max(0, len(t) - length + 1)))
    found.sort()
    fps = np.array([f[0] for f in found])
    groups = np.concatenate([[0], np.cumsum(fps[1:] != fps[:-1])])
    flags = repeats.repeated_starts(groups, [texts[i][s : s + n + length - 1] for _, i, s, n, _ in found], np.array([o for *_, o in found]), length)
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    for (_, i, s, n, _), f in zip(found, flags):
        assert f.tolist() == [count[texts[i][x : x + length]] > 1 for x in range(s, s + n)]


def brute_contamination(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = {}
    for item, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for d, t, *_ in docs:
        w, hit, found = cut(t), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        out.append((str(d), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination(spark, monkeypatch):
    rnd = random.Random(4)
    vocabulary = ["the", "of", "ÉÉ", "éé", "x9", *(f"w{i}" for i in range(12))]
    some = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", ",", "\n"]) for _ in range(n))
    items = [(i, some(n)) for i, n in enumerate([0, 1, 2, 3, 5, 12, 13, 14, 20, 40, 40])] + [(20, None), (21, "!!"), (22, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (23, "Solo"), (9, "another item nine")]
    docs = [(None, None, "en", "a"), (1, "", "en", "a"), (2, "solo", "en", "a"), (3, "w1 " * 60, "en", "a"), (4, "?!", "en", None)]
    for i in range(5, 80):
        parts = [some(rnd.randint(0, 30))]
        for _ in range(rnd.randrange(3)):
            words = items[rnd.choice([3, 4, 5, 6, 7, 8, 9, 10])][1].upper().replace("ÉÉ", "ÉÉ").split()
            parts += [" ".join(words[rnd.randrange(3) : len(words) - rnd.randrange(3)]), some(rnd.randint(0, 200))]
        docs.append((i, " ".join(parts), "en", "a"))
    docs += [docs[10], docs[10], (11, "another text of id 11", "en", "a"), (None, docs[12][1], "en", "a"), (200, "w2 of " * 20_000 + items[9][1] + " of" * 20_000, "en", "a")]
    df = documents(spark, docs).selectExpr("*", "1 AS w", "2 AS hits", "3 AS item_id", "4 AS tie")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'c' AS window", "'d' AS doc_id")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(decontaminate.contamination(df, bench)))
    assert got == brute_contamination(docs, items)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", -1)
    monkeypatch.setattr(decontaminate, "MAX_BITS", 1 << 16)
    joined = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(decontaminate.contamination(df, bench)))
    assert joined == got
    monkeypatch.setattr(decontaminate, "MIN_BITS", 64)
    monkeypatch.setattr(decontaminate, "MAX_BITS", 64)  # a table that is full changes nothing
    assert got == sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(decontaminate.contamination(df, bench)))
    assert [decontaminate.filter_bits(n) for n in (0, 10**6)] == [64, 64]
    df = df.selectExpr("*", "5 AS __d", "6 AS __t", "7 AS __i")
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not x[-1] for x in got)
    assert all(not r["contaminated"] for r in rows(decontaminate.contamination(df, bench.where("false"))))
    assert decontaminate.contamination(df.where("false"), bench).count() == 0
