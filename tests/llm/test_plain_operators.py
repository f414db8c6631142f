"""Operators 2, 3, 4, 6 and 9 against plain Python."""

import hashlib
import os
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents, rows, table, texts  # noqa: E402

from hopline.llm import chunks, exact_dedup, mixing, token_counts, token_records, url_filter  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return table(160)


def test_token_counts(spark, docs):
    long_text = "word Other, " * 30_000 + "ѐԱა\U0001f600 ४५ ⅷ"
    all_docs = docs + [(10_000, long_text, "en", "a"), (None, "no id", "en", "a"), (5, "again", "en", None), (5, "again", "en", None)]
    got = rows(token_counts.count_tokens(documents(spark, all_docs), PATH, limit=40))
    want = [(d, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 40) for d, t, *_ in all_docs]
    assert sorted((tuple(r.values()) for r in got), key=str) == sorted(want, key=str)


def test_token_counts_empty_table(spark):
    assert rows(token_counts.count_tokens(documents(spark, []), PATH)) == []


def test_pre_token_classes_agree_with_library():
    import pyarrow as pa
    import pyarrow.compute as pc

    own = token_counts.PreTokens(PATH)
    known = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    odd = pc.match_substring_regex(pa.array(map(chr, known)), chunks._UNKNOWN).to_pylist()
    known = [c for c, o in zip(known, odd) if not o]
    assert len(known) > 30_000
    for c in known:
        text = f"a{chr(c)}1 {chr(c)} b{chr(c)}"
        assert own.find(text) == [text[a:b] for _, (a, b) in own.tokenizer.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def encoded(enc, some):
    import pyarrow as pa

    return [np.frombuffer(b, "<u2").tolist() for b in enc.batch(pa.array(some, pa.string()))]


@pytest.mark.parametrize("size", [8 << 20, 200])
def test_small_caches_and_parts_change_nothing(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(token_counts, "CACHE", 5)
    monkeypatch.setattr(token_records, "CACHE", 5)
    monkeypatch.setattr(chunks, "BATCH_BYTES", size)
    own, enc = token_counts.PreTokens(PATH), token_records.Encoder(PATH, "<u2")
    some = [t or "" for t in texts(120, 7)]
    for part in (some, some[5:90], [], [""]):
        assert own.counts(pa.array(part, pa.string()), {}).tolist() == [len(ids_of(t)) for t in part]
        assert encoded(enc, part) == [ids_of(t) for t in part]


@pytest.mark.parametrize("b", [" ", "  ", "\n ", " \n", "   ", "\t", "\xa0 ", "\x1c ", "\x85 ", "\u3000 "])
def test_chunks_keep_ids(b):
    some = [f"{a}{b}{c} word{b}{c}" for a in ["", "x", "  ", "\n", " \n", "\u3000", "don't"] for c in ["", "y", " ", "'s 12", "\n"]]
    assert encoded(token_records.Encoder.get(PATH, "<u2"), some) == [ids_of(t) for t in some]


def test_token_records(spark, docs, tmp_path):
    all_docs = docs + [(None, "no id", "en", "a"), (5, "again", "en", None), (9999, "word, " * 40_000, "en", "a")]
    index, out = token_records.export_tokens(documents(spark, all_docs), PATH, str(tmp_path / "o"))
    got = sorted(rows(index), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d for d, *_ in all_docs), key=lambda x: (x is not None, x))
    assert got[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    want = sorted((str(d), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t, *_ in all_docs for i in [ids_of(t) + [0]])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    for r in got[:20]:  # a shuffled reader seeks by the index
        with open(f"{out}/records/{r['file']}", "rb") as f:
            f.seek(r["offset"])
            (_, payload), = token_records.records(f.read(r["bytes"]))
        assert len(payload) == 16 + 2 * r["n_tokens"]


def test_token_records_empty_table(spark, tmp_path):
    index, _ = token_records.export_tokens(documents(spark, []), PATH, str(tmp_path / "o"))
    assert rows(index) == []


def test_damaged_records_are_found():
    good = token_records.frame(b"payload") + b"\n"
    assert list(token_records.records(good * 2)) == [(0, b"payload"), (len(good), b"payload")]
    for k in range(len(good)):
        with pytest.raises(ValueError):
            list(token_records.records(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :]))
    with pytest.raises(ValueError):
        list(token_records.records(good[:-1]))


def sizes_of(docs):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in docs]


def test_mixing_targets_and_takes(spark, docs):
    placed, taken = mixing.queue(documents(spark, docs))
    got = {r["__row"]: r for r in rows(placed)}
    source = {r["doc_id"]: r for r in got.values()}
    totals, sizes = {}, sizes_of(docs)
    for (_, _, _, s), n in zip(docs, sizes):
        totals[s] = totals.get(s, 0) + n
    names = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, budget = {}, set(names), 1.5 * sum(totals.values())
    while open_:  # share, cut off, share again
        left = budget - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * totals[s]}
        target |= {s: 2 * totals[s] for s in full} if full else share
        open_ = open_ - full if full else set()
    took = {}
    for t in rows(taken):
        took[t["__row"]] = took.get(t["__row"], 0) + t["size"]
    per_source = {}
    for (d, _, _, s), n in zip(docs, sizes):
        r = source[d]
        assert r["size"] == n and r["source_size"] == totals[s] and r["target"] == pytest.approx(target[s])
        assert took.get(r["__row"], 0) in (0, n, 2 * n)
        per_source[s] = per_source.get(s, 0) + took.get(r["__row"], 0)
    assert sum(per_source.values()) <= budget
    for s in names:
        assert abs(per_source[s] - target[s]) <= 2 * max(sizes), s


def test_mix_gives_whole_rows_in_order_and_again_the_same(spark, docs):
    all_docs = docs + [(5, "again twice", "en", None), (5, "again twice", "en", None), (None, "no id", None, None), (900, "word " * 50_000, "en", "a")]
    df = documents(spark, all_docs).selectExpr("*", "1 AS __row", "2 AS __r", "3 AS __copy", "4 AS __finish", "5 AS __key")
    one, two = mixing.mix(df).collect(), mixing.mix(df).collect()
    assert mixing.mix(df).columns == df.columns
    assert one == two  # in the same order
    placed, taken = mixing.queue(documents(spark, all_docs))
    finish = [(r["doc_id"], r["finish"]) for r in taken.join(placed.select("__row", "doc_id"), "__row").orderBy("finish").collect()]
    assert len(finish) == len(one)
    at = {}
    for d, f in finish:
        at.setdefault(d, []).append(f)
    times = [at[r["doc_id"]] for r in one if len(at[r["doc_id"]]) == 1]
    assert times == sorted(times) and len(times) > 20
    assert mixing.mix(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, weights=(1.0, 0.0))


@pytest.mark.parametrize("bits,hot", [(1 << 26, 10_000), (256, 10_000), (256, 5), (1 << 26, 5)])
def test_exact_dedup(spark, docs, monkeypatch, bits, hot):
    """In one table or in many, and with digests that count as hot or not."""
    monkeypatch.setattr(exact_dedup, "MAX_BITS", bits)
    monkeypatch.setattr(exact_dedup, "MIN_BITS", 64)
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    all_docs = docs + [(None, "one", "en", "a"), (4, "ONE", "en", "a"), (4, "ONE", "en", "a"), (70_000, "É", "en", "a"), (70_001, "é", "en", "a")] + [(80_000 + i, "hot", "en", "a") for i in range(300)]
    got = rows(exact_dedup.exact_duplicates(documents(spark, all_docs)))
    groups = {}
    for d, t, *_ in all_docs:
        groups.setdefault(hashlib.sha256(lowered(t).encode()).hexdigest(), []).append(d)
    want = [(str(d), max((x for x in g if x is not None), default=None), len(g), h) for h, g in groups.items() for d in g]
    assert sorted(((str(r["doc_id"]), r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == sorted(want, key=str)
    assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0


def test_bloom_passes_lone_rows_straight_through(spark):
    digests = spark.range(20_000).selectExpr("id", "id AS __row", "unhex(sha2(cast(id % 19000 AS string), 256)) AS digest")
    assert [exact_dedup.parts_of(n) for n in (0, 20_000, 10**7, 10**10)] == [(1, 1 << 16), (1, 1 << 19), (4, 1 << 26), (4096, 1 << 26)]
    maybe, alone = exact_dedup.split_by_bloom(digests, exact_dedup.parts_of(20_000)[1])
    assert maybe.count() + alone.count() == 20_000
    assert maybe.count() < 2_000 + 1_500 and alone.where("id < 1000 OR id >= 19000").count() == 0


def glob_regex(glob):
    out = "".join({"**": ".*", "*": "[^/]*", "?": "."}.get(p, re.escape(p)) for p in re.findall(r"\*\*|\*|\?|[^*?]", glob))
    return re.compile(out, re.S)


def test_automaton_against_regex():
    globs = ["*.com/en/**", "?bc", "a*c", "a**c", "**", "*", "", "**/x/**", "a?c*", *(f"*.site{i}.org/p**" for i in range(30))]
    strings = ["", "abc", "a/c", "ac", ".x.com/en/", ".x.com/enx", ".x/y.com/en/", "q/x/y", "abcc", "abc/", ".a.site7.org/p9", ".site29.org/p", "/x/"]
    got = url_filter.GlobAutomaton(globs).matches([s.encode() for s in strings])
    for i, s in enumerate(strings):
        for j, g in enumerate(globs):
            assert got[i, j] == bool(glob_regex(g).fullmatch(s)), (s, g)


def test_url_filter_edge_cases(spark):
    from hopline.llm.queries import URL_RULES

    urls = {1: None, 2: "", 3: "no scheme.com/en/", 4: "http://A.COM/en/", 5: "http://xcom/en/", 6: "http://com/en/", 7: "http://example.com/en/7?x", 8: "http://m.example.com/en/8#t", 9: "x://n.net?/de/", 10: "h://example.net/de/80", 11: "h://a.org/es", 12: "h://a.org/es/" + "y" * 5000, 13: "h://b.com/EN/", 14: "a://b://c.com/en/", None: "h://a.org/es/"}
    df = spark.createDataFrame([(k, v, "h", "clash") for k, v in urls.items()], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in rows(url_filter.judge_urls(df, URL_RULES))}
    assert got[1] == got[2] == got[3] == ("", None, "allow")
    assert got[4] == ("a.com", "com/en/", "block") and got[5] == ("xcom", None, "allow") and got[6][1] == "com/en/"
    assert got[7][1:] == ("example.com/en/7", "allow") and got[8][1:] == ("com/en/", "block") and got[9] == ("n.net", None, "allow")
    assert got[10][1:] == ("example.net/de/8", "block") and got[11][2] == "allow" and got[12][2] == got[None][2] == "block" and got[13][2] == "allow"
    assert got[14] == ("b:", None, "allow")
    assert url_filter.judge_urls(df.where("false"), URL_RULES).count() == 0
