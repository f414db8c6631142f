"""Results do not change when the files of the input are split anew between two jobs of an operator."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from helpers import table  # noqa: E402

from hopline.llm import mixing, pii, repeats  # noqa: E402

KEY = b"k"
SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def scattered(spark, tmp_path):
    """A table in many files, and a function that makes a step of an operator split it anew when it is done."""
    rows = [(i, f"{t or ''} a{i}@x{i}.org " + "same long passage " * (30 if i % 3 == 0 else 0), lang, s) for i, t, lang, s in table(40, seed=9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.repartition(16, "doc_id").write.parquet(str(tmp_path / "t"))
    before = spark.conf.get(SPLIT)

    def after(monkeypatch, module, name):
        step = getattr(module, name)

        def run(*args, **named):
            out = step(*args, **named)
            spark.conf.set(SPLIT, "1k")
            return out

        monkeypatch.setattr(module, name, run)

    spark.conf.set(SPLIT, "128m")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield spark.read.parquet(str(tmp_path / "t")), after
    spark.conf.set(SPLIT, before)
    for c in ("openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{c}")


def both(spark, run, monkeypatch, after, module, step):
    want = sorted(map(str, run().collect()))
    after(monkeypatch, module, step)
    got = sorted(map(str, run().collect()))
    assert spark.conf.get(SPLIT) == "1k" and got == want


def test_pseudonymize(spark, scattered, monkeypatch):
    df, after = scattered
    real = pii.surrogate
    # all local parts fall on few surrogates at first, so that later attempts matter
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, norm, n: real(key, kind, "a@b.org", 0) if n == 0 else real(key, kind, norm, n))
    monkeypatch.setattr(pii, "settle", lambda e, key: e.selectExpr("kind", "norm", "1 AS attempt"))
    both(spark, lambda: pii.pseudonymize(df, KEY), monkeypatch, after, pii, "settle")


def test_repeats(spark, scattered, monkeypatch):
    df, after = scattered
    both(spark, lambda: repeats.remove_repeats(df, 40), monkeypatch, after, repeats, "repeated_runs")


def test_mix(spark, scattered, monkeypatch):
    df, after = scattered
    df = df.union(df.where("doc_id < 5"))  # whole rows that are there twice
    both(spark, lambda: mixing.mix(df), monkeypatch, after, mixing, "queue")
