"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the documents of the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hopline.llm import decontaminate, mixing, quality, simhash, token_records
from hopline.llm.common import read_table
from hopline.session import materialize, tidy_driver

TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as of low quality or toxic, go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard similarity of their five-word shingles 0.8 or more) one document stays."""
    return simhash.keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words stand in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in mixing order."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Record files in the shared folder, in the order of the files of ``docs``, which is the mixing order; the rows are their offset index."""
    index, _ = token_records.export_tokens(docs, public_tokenizers.path(TOKENIZER), order=("_metadata.file_path", "_metadata.row_index"), slice_rows=500)
    return index


def _tidied(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy_driver(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(f.__name__, _tidied(f)) for f in (quality_classifier, simhash_near_dedup, benchmark_decontamination, source_mixing, token_output)]

#: SQL has neither the classifier nor the hashes of the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
