"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing to target weights, byte-level BPE.

Each stage works on all that the stage before has kept. The first four return the columns of documents; the last one
gives a row a document that is left: doc_id, n_tokens, ids_sha256 and decoded_sha256.

A stage's result has to be written before the next stage is called, as run() does: the next stage deletes the scratch
tables of the one before. Any column may hold nulls; repeated rows, empty and long texts, empty tables and further
columns of any name are allowed, with the results that the operators' docstrings state.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, line_dedup, mixing, ngram_join, quality
from corpusloom.llm.common import table
from corpusloom.storage import delete, discard, recorded, stored

_left = threading.local()


def _stage(function):
    """function, which first deletes the tables that the stage before has left in the shared folder."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, *getattr(_left, "paths", ()))
        _left.paths = []
        spark._jvm.System.gc()  # the shuffle files of the stage before
        with recorded(_left.paths):
            return function(spark, docs, sf_dir)

    run.__doc__ = function.__doc__
    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go, null and empty texts among them; repeated rows share their fate."""
    return quality.quality_filter(docs)


@_stage
def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and documents of which nothing is left; n_chars follows the text."""
    out = line_dedup.without_repeats(docs)
    if "n_chars" not in out.columns:
        return out
    return out.selectExpr(*(f"CAST(length(text) AS {kind}) AS n_chars" if c == "n_chars" else f"`{c}`" for c, kind in out.dtypes))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least id: five words, similarity 0.8. Null ids all stay; of rows that share an id one stays."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


@_stage
def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the calibrated probabilities of their source, language and form; nulls are categories of their own, repeated ids share their draw."""
    return mixing.sample(docs)


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids by the byte-level vocabulary, decoded again: a row of digests a document. A null text is empty."""
    return bpe.encode_digests(docs, *bpe.default_vocabulary())


STAGES = [("quality_rules", quality_rules), ("line_dedup", repeated_lines), ("ngram_join", near_duplicates), ("mixing", target_weights), ("bpe", encoding)]

#: Byte-level BPE has no SQL form; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
            if k:
                discard(before)
    return docs
