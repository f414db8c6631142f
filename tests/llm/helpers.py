"""Small tables for the corpus operators."""

from __future__ import annotations

import random

WORDS = "the and of to in is it for on was with as by at from that this here there when idiot trash über ça niño 東京 слово a1 b2 c3".split()


def texts(n: int, seed: int = 1, most: int = 60) -> list[str | None]:
    """Texts with nulls, empty ones, copies, copies in another case, and odd white space."""
    rnd = random.Random(seed)
    out: list[str | None] = [None, "", " ", "\n\t", "one", "One", "one two", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "x  y   z ", " \n lead", "tail \n "]
    while len(out) < n:
        t = " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ",", ".\n", "!", "  "]) for _ in range(rnd.randint(1, most)))
        out += [t] * rnd.choice([1, 1, 1, 2]) + [t.upper()] * rnd.choice([0, 0, 0, 1])
    return out[:n]


def documents(spark, rows: list[tuple], extra: bool = True):
    """A documents table; ``extra`` adds columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if extra:
        for c in ("id", "n", "size", "digest", "rule", "fp", "key", "count", "tokens", "part"):
            df = df.selectExpr("*", f"'x' AS `{c}`")
    return df


def table(n: int, seed: int = 1, ids=None, sources=("a", "b", "B", None), most: int = 60) -> list[tuple]:
    rnd = random.Random(seed + 1)
    body = texts(n, seed, most)
    return [(i if ids is None else ids[i], body[i], "en", "a" if rnd.random() < 0.4 else rnd.choice(sources)) for i in range(n)]


def rows(df):
    return [r.asDict() for r in df.collect()]
