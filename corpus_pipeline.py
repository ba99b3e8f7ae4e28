"""A training corpus from raw documents: identify, filter, deduplicate, decontaminate, tokenise.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the
docs of the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import bpe, decontaminate, language, ngram_join, toxicity
from tabloom.llm.common import table, written

#: No SQL states learned filters or byte-pair merges; the tests hold every stage against plain Python instead.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without one go."""
    return language.keep_identified(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, in whatever spelling."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates (five words, similarity 0.8)."""
    return ngram_join.keep_first(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids, and the digest of the text that they decode to."""
    return bpe.bpe_ids(docs)


STAGES: list[tuple[str, Callable]] = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
