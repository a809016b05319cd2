"""A corpus pipeline over the documents table: five stages, each one of the training-data operators over all that is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notegrid.llm import decontaminate, language_id, ngram_join, packing, secret_scan
from notegrid.llm.common import materialize, read, tune, unused

#: Documents whose language has a posterior below this are rejected, as are those without letters.
LEAST_SCORE = 0.5


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in a language that it knows stay."""
    tune(spark)
    pred, score = unused(docs, "lang_pred"), unused(docs, "score")
    out = language_id.identify(docs, pred, score)
    return out.where((out[pred] != language_id.UNKNOWN) & (out[score] >= LEAST_SCORE)).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the document of the smallest doc_id of every group of near duplicates stays."""
    tune(spark)
    return ngram_join.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold no window of a benchmark item stay."""
    tune(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every document stays, its secrets masked."""
    tune(spark)
    return secret_scan.redact(docs, secret_scan.learn(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every document's pieces and their places in sequences."""
    tune(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_identified),
    ("ngram_join", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: SQL cannot express the language model, the automata and the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written to the shared folder and read again."""
    tune(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
