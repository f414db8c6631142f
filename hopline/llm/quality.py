"""Quality classifier with hierarchical empirical Bayes.

A linear model on hashed words gives each document evidence, in logits, of being of low quality and of being toxic. The evidence of all documents is
then summed by site, here a host (``source``) and a path under it (``source``, ``lang``). Each site's rate has a beta posterior whose prior is its
parent's: paths shrink towards their host, hosts towards the whole corpus, with a strength that the spread of rates between sites sets. A document's
score is its own evidence plus the log odds of its site, as all other documents of the site tell them, against those of the corpus.

The models are fitted from sums made on the cluster: the driver gets counts by bucket (a bounded table) and a few figures of each sampled document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.llm.common import give_back
from hopline.session import discard, materialize

#: The models are fitted on at most so many labelled documents, those least by a hash of their id.
SAMPLE_ROWS = 8_000
BUCKETS = 1 << 16
#: Sites up to which their table is broadcast (under 100 bytes each); beyond, it is joined.
BROADCAST_SITES = 100_000
#: Range of the strength, in documents, with which a site is drawn to its parent, and the weight of the site's log odds.
STRENGTH, SITE_WEIGHT = (5.0, 5_000.0), 0.5
#: Standard errors by which a word's log odds are drawn to zero.
CERTAIN = 2.5
#: Letters of a word's stem.
STEM = 5
#: Words whose buckets a worker remembers, and the longest of them.
KNOWN, LONGEST = 1 << 18, 48
#: Texts of which the features are held at a time.
SLICE = 256

_SHAPES, _FIGURES = 12, 4
_WORD = re.compile(r"\w+")
_MARKS, _TABLES, _DIGITS = (list(x) for x in (b"!%&$*#@^~<>", b"|{}[]=;", b"0123456789"))


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode()) % BUCKETS


class _Buckets(dict):
    """word -> its bucket + BUCKETS * (bucket of its stem + 1, or 0 for a short word), remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        found = bucket(word) + (BUCKETS * (bucket("^" + word[:STEM]) + 1) if len(word) > STEM else 0)
        if len(word) <= LONGEST:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = found
        return found


_buckets = _Buckets()


def forget() -> None:
    """Between batches: workers live on, and other stages need their memory."""
    _buckets.clear()
    give_back()

Features = tuple[np.ndarray, np.ndarray, np.ndarray]


def features(text: str | None) -> Features:
    """(buckets of words and of their first five letters, how often each occurs, figures that do not depend on which words they are) of a whole text."""
    text = text or ""
    raw, words = text.encode(), _WORD.findall(text.lower())
    n, w = max(1, len(raw)), max(1, len(words))
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    per_byte = lambda chars: float(kinds[chars].sum()) / n
    both = np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))
    shape = np.array(
        [
            1.0,
            math.log1p(w) / 5,
            float(kinds[65:91].sum() + kinds[97:123].sum() + kinds[128:].sum()) / n,
            float(kinds[65:91].sum()) / n * 5,
            per_byte(_MARKS) * 10,
            per_byte(_TABLES) * 10,
            per_byte(_DIGITS) * 10,
            len(set(words)) / w,
            float((both[1:] == both[:-1]).sum()) / w * 2,
            min(20.0, n / w) / 10,
            float(kinds[10]) / w * 5,
            float(len(words) < 20),
        ]
    )
    stems = both // BUCKETS
    buckets, often = np.unique(np.concatenate([both % BUCKETS, stems[stems > 0] - 1]).astype(np.int32), return_counts=True)
    return buckets, often.astype(float), shape


@dataclass
class Model:
    """Log odds from distinct words (naive Bayes, clipped) and from shape (logistic regression), added up by a second regression."""

    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def evidence(self, found: Features) -> float:
        return float(np.concatenate([word_figures(self.words, found), (found[2] - self.mean) / self.scale]) @ self.shapes)


def word_figures(odds: np.ndarray, found: Features) -> np.ndarray:
    """What the log odds of a text's words say together: the strongest, the sum of the strong ones and that sum by length, the mean."""
    if not len(found[0]):
        return np.zeros(_FIGURES)
    mine, often = odds[found[0]], found[1]
    strong = float(np.maximum(mine - 1, 0) @ often)
    return np.array([mine.max(), math.log1p(strong), math.log1p(strong / often.sum() * 100), float(mine @ often) / often.sum() * 3])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; classes weigh alike."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def word_odds(held: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Log odds of each bucket's rate among all words, from arrays (2 classes, BUCKETS) of the documents that hold it and of how often it occurs.

    They are drawn to zero by what is uncertain: a word that few documents hold says nothing.
    """
    held, often = held + 0.5, often + 0.5
    rate = often / often.sum(axis=1, keepdims=True)
    odds = np.log(rate[1]) - np.log(rate[0])
    error = np.sqrt((1 / held).sum(axis=0))
    return np.sign(odds) * np.maximum(np.abs(odds) - CERTAIN * error, 0)


def _constant() -> Model:
    return Model(np.zeros(BUCKETS), np.array([0.0] * _FIGURES + [-6.0] + [0.0] * (_SHAPES - 1)), np.zeros(_SHAPES), np.ones(_SHAPES))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            found = [features(t.as_py()) for t in part.column("text")]
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([part.column("low"), part.column("toxic"), part.column("fold"), *cols], ["low", "toxic", "fold", "buckets", "often", "shape"])
        forget()


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(low, toxic, fold, buckets, often, shape) of the sample: labelled rows, at most SAMPLE_ROWS of them, least by a hash of their id and text."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("__l"), "quality", "toxic").where("__l IS NOT NULL").orderBy(F.xxhash64("__l"), "__l", "quality", "toxic").limit(SAMPLE_ROWS)
    mine = docs.select(F.col(id_col).cast("long").alias("__d"), F.col(text_col).alias("text"))
    sample = mine.join(F.broadcast(wanted), F.col("__d") == F.col("__l")).withColumn("__t", F.xxhash64("text"))
    sample = sample.orderBy(F.xxhash64("__d"), "__d", "__t", "quality", "toxic").limit(SAMPLE_ROWS)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    slim = sample.select(flag(F.col("quality") == 0).alias("low"), flag(F.col("toxic") == 1).alias("toxic"), F.pmod(F.xxhash64("__d", "__t"), F.lit(2)).cast("int").alias("fold"), "text")
    return slim.mapInArrow(_featured, "low int, toxic int, fold int, buckets array<int>, often array<double>, shape array<double>")


def _counts(found: DataFrame, name: str) -> np.ndarray:
    """[held or often, fold, class, bucket]: sums over the sample, made on the cluster; BUCKETS rows at most come to the driver."""
    each = found.select("fold", F.col(name).alias("y"), F.explode(F.arrays_zip("buckets", "often")).alias("x"))
    sums = []
    for fold in (0, 1):
        for y in (0, 1):
            here = (F.col("fold") == fold) & (F.col("y") == y)
            sums += [F.count(F.when(here, 1)).alias(f"h{fold}{y}"), F.sum(F.when(here, F.col("x.often")).otherwise(0.0)).alias(f"o{fold}{y}")]
    table = each.groupBy(F.col("x.buckets").alias("b")).agg(*sums).toArrow()
    out, at = np.zeros((2, 2, 2, BUCKETS)), table.column("b").to_numpy()
    for fold in (0, 1):
        for y in (0, 1):
            for i, c in enumerate("ho"):
                out[i, fold, y, at] = table.column(f"{c}{fold}{y}").to_numpy()
    return out


def _figured(spark, odds: list[list[np.ndarray]]):
    """Rows of the sample -> label, fold and word figures for each model, from the odds of the other fold."""
    table = spark.sparkContext.broadcast(odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[] for _ in table.value]
            for fold, buckets, often in zip(batch.column("fold").to_pylist(), batch.column("buckets"), batch.column("often"), strict=True):
                found = (buckets.values.to_numpy(), often.values.to_numpy(), None)
                for out, by_fold in zip(rows, table.value, strict=True):
                    out.append(word_figures(by_fold[1 - fold], found))
            cols = [pa.array(r, pa.list_(pa.float64())) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("low"), batch.column("toxic"), batch.column("shape"), *cols], ["low", "toxic", "shape", *(f"w{i}" for i in range(len(rows)))])

    return run


def fit_models(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Model]:
    """Models of ``low`` (quality 0) and ``toxic`` (toxic 1) from the bounded sample; a class without examples gives a constant model.

    Word odds for the second regression come from the other half of the sample, so that it does not trust words too much. A document with two labels
    counts with each of them. The driver gets BUCKETS rows of sums and, for each sampled document, its shape and word figures.
    """
    names = ("low", "toxic")
    found = materialize(labelled_features(docs, labels, id_col, text_col), "sample")
    counts = {n: _counts(found, n) for n in names}
    odds = [[word_odds(*counts[n][:, k]) for k in (0, 1)] for n in names]
    table = found.mapInArrow(_figured(docs.sparkSession, odds), "low int, toxic int, shape array<double>, w0 array<double>, w1 array<double>").toArrow()
    discard(found)
    shapes = table.column("shape").combine_chunks().flatten().to_numpy().reshape(-1, _SHAPES)
    out = {}
    for i, n in enumerate(names):
        y = table.column(n).to_numpy().astype(float)
        if not y.any() or y.all():
            out[n] = _constant()
            continue
        mean, scale = shapes.mean(axis=0), shapes.std(axis=0) + 1e-6
        mean[0], scale[0] = 0.0, 1.0
        figures = table.column(f"w{i}").combine_chunks().flatten().to_numpy().reshape(-1, _FIGURES)
        beta = _logistic(np.concatenate([figures, (shapes - mean) / scale], axis=1), y)
        out[n] = Model(word_odds(*counts[n].sum(axis=1)), beta, mean, scale)
    return out


def evidence(docs: DataFrame, models: dict[str, Model], text_col: str = "text") -> DataFrame:
    """``docs`` and a column of logits for each model, over whole texts. Map-only."""
    spark, names = docs.sparkSession, list(models)
    table = spark.sparkContext.broadcast(models)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def score(texts):
        import pandas as pd

        out = np.array([[table.value[n].evidence(f) for n in names] for f in map(features, texts)]).reshape(-1, len(names))
        forget()
        return pd.DataFrame(out, columns=names)

    return docs.withColumn("__e", score(F.col(text_col)))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (F.lit(1.0) - p))


def _probability(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _strength(rate: str, n: str, base: Column) -> Column:
    """Of a beta prior, by moments: how much the rates of sites spread beyond what their sizes explain."""
    spread = F.sum(F.col(n) * F.pow(F.col(rate) - base, F.lit(2))) / F.sum(n)
    expected = F.sum(base * (F.lit(1.0) - base)) / F.sum(n)
    excess = F.greatest(spread - expected, F.lit(1e-9))
    return F.least(F.greatest(F.max(base * (F.lit(1.0) - base)) / excess, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))


@dataclass
class Prior:
    """Of one model: the corpus rate, and the strengths with which hosts are drawn to it and paths to their host."""

    base: float
    host: float
    path: float

    def odds(self, site_sum: Column, site_n: Column, host_sum: Column, host_n: Column, own: Column) -> Column:
        """Log odds of a path's posterior against the corpus, without the document whose probability is ``own``."""
        base, k, j = (F.lit(float(x)) for x in (self.base, self.host, self.path))
        above = (host_sum - own + k * base) / (host_n - F.lit(1.0) + k)
        return _logit((site_sum - own + j * above) / (site_n - F.lit(1.0) + j)) - _logit(base)


def site_sums(scored: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, Prior]]:
    """(host, path, n, hn, s_<name>, h_<name>): documents and summed probabilities of each path and of its host, and the priors.

    Evidence is summed by site with partial aggregates, over all documents. Three short levels: sites, hosts, the corpus.
    """
    sums = [F.sum(_probability(F.col(f"__e.{n}"))).alias(f"s_{n}") for n in names]
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *(F.sum(f"s_{n}").alias(f"h_{n}") for n in names))
    whole = paths.agg(F.sum("n").alias("wn"), *(F.sum(f"s_{n}").alias(f"w_{n}") for n in names)).first()
    sites = paths.alias("p").join(hosts.alias("q"), F.expr("p.host <=> q.host")).select("p.*", "hn", *(f"h_{n}" for n in names))
    priors = {}
    for n in names:
        base = (whole[f"w_{n}"] or 0.0) / (whole["wn"] or 1.0)
        k = hosts.withColumn("rate", F.col(f"h_{n}") / F.col("hn")).agg(_strength("rate", "hn", F.lit(base)).alias("k")).first()["k"] or STRENGTH[1]
        shrunk = (F.col(f"h_{n}") + F.lit(float(k) * base)) / (F.col("hn") + F.lit(float(k)))
        j = sites.withColumn("rate", F.col(f"s_{n}") / F.col("n")).agg(_strength("rate", "n", shrunk).alias("k")).first()["k"] or STRENGTH[1]
        priors[n] = Prior(base, float(k), float(j))
    return sites, priors


def decided(scored: DataFrame, sites: DataFrame, priors: dict[str, Prior], threshold: float) -> DataFrame:
    """``scored`` (host, path, __e) with the posterior log odds ``__l_<name>`` and ``__keep``."""
    hint = F.broadcast if sites.count() <= BROADCAST_SITES else (lambda x: x)
    renamed = sites.select(F.col("host").alias("__h"), F.col("path").alias("__p"), *(F.col(c).alias(f"__{c}") for c in sites.columns if c not in ("host", "path")))
    both = scored.join(hint(renamed), F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p")))
    for n, prior in priors.items():
        own = F.col(f"__e.{n}")
        site = prior.odds(F.col(f"__s_{n}"), F.col("__n"), F.col(f"__h_{n}"), F.col("__hn"), _probability(own))
        both = both.withColumn(f"__l_{n}", own + F.lit(SITE_WEIGHT) * site)
    below = [F.col(f"__l_{n}") < F.lit(float(threshold)) for n in priors]
    return both.withColumn("__keep", reduce(Column.__and__, below, F.lit(True)))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 1.0
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, host, path, low, toxic (posterior log odds) and keep.

    A document is kept if both log odds are below ``threshold``; one that ties with it goes. Null texts count as empty; a null host or path is a site of
    its own; a null id is kept as it is; repeated rows are scored each for itself; very long texts are read whole; an empty table gives an empty result;
    other columns do not matter. Without labels of a class, nothing is rejected for it. Of a site with one document only its parents count.
    """
    models = fit_models(docs, labels, id_col, text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).alias("__text"))
    scored = materialize(evidence(slim, models, "__text").drop("__text"), "scored")
    out = decided(scored, *site_sums(scored, list(models)), threshold)
    return out.select("doc_id", "host", "path", *(F.col(f"__l_{n}").alias(n) for n in models), F.col("__keep").alias("keep"))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 1.0
) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps; ``classify`` says how nulls, ties, repeated rows, long texts and empty tables count.

    Whole rows are written once beside their evidence, as the decision needs the sums of all documents first: texts are read by the classifier once and
    never shuffled. Columns of any name come through.
    """
    models, cols = fit_models(docs, labels, id_col, text_col), docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(cols))).alias("__r"), F.col(host_col).alias("host"), F.col(path_col).alias("path"))
    scored = materialize(evidence(whole, models, f"__r.k{cols.index(text_col)}"), "scored")
    kept = decided(scored, *site_sums(scored.select("host", "path", "__e"), list(models)), threshold).where("__keep")
    return kept.select(*(F.col(f"__r.k{i}").alias(c) for i, c in enumerate(cols)))
