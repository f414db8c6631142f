"""Surrogates of names: enough of them, distinct as they are seen, and the same for all mentions of a document."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
from helpers import rows  # noqa: E402

from hopline.llm import pii  # noqa: E402

KEY = b"test key"


def test_more_names_than_the_first_attempts_have(spark, monkeypatch):
    """12 names of two or three syllables for 24 entities, whose titles differ."""
    monkeypatch.setitem(pii._NAMES, "latin", (["ba", "da"], {g: ["el"] for g in "mfu"}))
    for f in ("surrogate", "_name"):  # so that they go to the workers as they are here
        monkeypatch.setattr(pii, f, lambda *a, real=getattr(pii, f): real(*a))
    norms = [f"{g}:name{i}" for i in range(8) for g in "mfu"]
    df = spark.createDataFrame([("person", n, 0) for n in norms], "kind string, norm string, above int")
    later = {r["norm"]: r["attempt"] for r in rows(pii.settle(df, KEY))}
    final = {pii.surrogate(KEY, "person", n, later.get(n, 0)).partition(":")[2] for n in norms}
    assert later and len(final) == len(norms)


def replaced(text):
    return pii._replaced(text, KEY, {}, {})[0]


def test_later_mentions_have_the_parts_of_the_name():
    text = "Mr John Smith called. John Smith paid; Smith left. SMITH's car, Dr Smith, Mr Smith and Mr. JOHN SMITH; a smith stays."
    new = replaced(text)
    first, last = new.split()[1:3]
    last = last.rstrip(".")
    assert "Smith" not in new and "John" not in new and "SMITH" not in new
    want = f"Mr {first} {last} called. {first} {last} paid; {last} left. {last.upper()}'s car, Dr {last}, Mr {last} and Mr. {first.upper()} {last.upper()}; a smith stays."
    assert new == want


def test_people_of_one_surname():
    new = replaced("Mrs Smith met Mr Smith. Frau Jane Doe and Herr Max Doe: Jane Doe sat, Max Doe stood, Herr Doe left. Иван ждал").split()
    assert new[1] != new[4].rstrip(".")
    (jane, doe), (max_, other) = new[6:8], [w.rstrip(":") for w in new[10:12]]
    assert new[12:14] == [jane, doe] and new[15:17] == [max_, other] and new[19] == other
    assert replaced("господин Иван Петров был. Петров ушёл").split()[4] == replaced("господин Иван Петров был. Петров ушёл").split()[2]
    assert replaced("Smith met John Smith") == "Smith met John Smith"


def test_small_formats_that_are_all_in_use(spark):
    """All hundred two-digit addresses of a domain, and all one-letter domains."""
    docs = [(i, f"{i:02d}@x.com") for i in range(100)] + [(100 + i, f"a@{c}.org") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    out = {r["doc_id"]: r["text"] for r in rows(pii.pseudonymize(spark.createDataFrame(docs, "doc_id long, text string"), KEY))}
    assert len(set(out.values())) == len(docs) and not set(out.values()) & {t for _, t in docs}
    domains = {out[i].split("@")[1] for i in range(100)}
    assert len(domains) == 1 and len({t.split("@")[1] for t in out.values()}) == 27
    assert not {t.split("@")[1] for t in out.values()} & {t.split("@")[1] for _, t in docs}


def test_more_entities_than_short_names(spark):
    letters = "bcdfghjklm"
    names = [f"{a}{b}{c}{d}e".capitalize() for a in letters for b in "aeiou" for c in letters for d in "aeiou" for _ in [0]]
    names = [f"{n}{x}" for n in names for x in letters + "nprstvwxyz"]  # 50,000 surnames
    cjk = [f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}" for i in range(1000)]
    docs = [(i, f"Mr {n} came") for i, n in enumerate(names)] + [(len(names) + i, f"Mr {n} came") for i, n in enumerate(cjk)]
    out = [r["text"] for r in rows(pii.pseudonymize(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), KEY))]
    assert len(set(out)) == len(docs) == 51_000 and not set(out) & {t for _, t in docs}


def test_layouts_are_kept():
    for text in ("John.Doe@Example.com", "josé@exämple.com", "+٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨", "2001:db8::8a2e:370:7334", "2001:0DB8:0000:0000:0000:8A2E:0370:7334", "fe80::1ff:fe23:4567:890a", "sk-proj-abcdefghij0123456789ABCD"):
        (e,) = pii.detect(f"is {text} so")
        new = replaced(f"is {text} so")[3:-3]
        assert (e[0], e[1]) == (3, 3 + len(text)) and new != text, text
        (again,) = pii.detect(f"is {new} so")
        assert again[2] == e[2] and (e[2] == "ipv6" or len(new) == len(text)), (text, new)
        assert e[2] == "ipv6" or [c.isupper() for c in new] == [c.isupper() for c in text] or e[2] == "secret"
    assert all("٠" <= c <= "٩" for c in replaced("+٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨") if c.isdigit())
    one, other = replaced("2001:db8::8a2e:370:7334"), replaced("2001:0DB8:0000:0000:0000:8A2E:0370:7334")
    assert int(pii.ipaddress.IPv6Address(one)) == int(pii.ipaddress.IPv6Address(other))
    for clean in ("at 12:30:45", "::1", "std::vector<int>", "a::b", "1:2:3", "C++ abc::def::9x"):
        assert replaced(clean) == clean
    first, last = replaced("Mr Jean-Luc O'Neil ate")[3:-4].split()
    assert [w[:1].isupper() for w in first.split("-")] == [True, True] and "'" in last and last[last.index("'") + 1].isupper()
    assert any(c > "z" for c in replaced("Herr Max Müller kam").lower()) and any(c > "z" for c in replaced("Mr Łukasz Żak").lower())


def test_against_a_plain_rewrite(spark):
    """The attempts by a plain loop over all entities, and each text rewritten with them."""
    docs = [(i, f"Mr {a} wrote from {b}@{c}.org to +1 555 010 00{i % 10}{i % 7}") for i, (a, b, c) in enumerate((a, b, c) for a in ("Ba Bo", "Li", "安白", "O'Hara") for b in "ab" for c in ("x", "yy"))]
    docs += [docs[0], (None, None), (77, ""), (78, "word " * 40_000 + "a@x.org")]
    entities = {(k, n) for _, t in docs if t for *_, k, n in pii.detect(t)}
    entities |= {("domain", pii.domain_of(n)) for k, n in entities if k == "email"}
    attempts, taken = {}, {(k, pii.visible(k, n)) for k, n in entities}
    for only_domains in (True, False):
        open_ = {e: 0 for e in entities if (e[0] == "domain") == only_domains}
        while open_:
            want = {}
            for (k, n), a in open_.items():
                above = attempts.get(("domain", pii.domain_of(n)), 0) if k == "email" else 0
                want.setdefault((k, pii.visible(k, pii.surrogate(KEY, k, n, a, above))), []).append(n)
            won = {(k, min(ns)): v for v, ns in want.items() for k in [v[0]] if v not in taken}
            taken |= set(won.values())
            attempts |= {e: open_[e] for e in won}
            open_ = {e: a + 1 for e, a in open_.items() if e not in won}
    memo = {}
    want = sorted((str(d), str(t if t is None else pii._replaced(t, KEY, attempts, memo)[0])) for d, t in docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS __row", "2 AS n_entities", "3 AS pii_email", "4 AS __text")
    out = pii.pseudonymize(df, KEY)
    assert out.columns[:6] == df.columns and out.columns[6] == "n_entities_" and "pii_email_" in out.columns and len(set(out.columns)) == len(out.columns)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == want
