"""A training corpus from raw documents, one operator after another.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the DataFrame
that is written as Parquet and read again as the next one's ``docs``. Every stage works on all rows its
predecessor kept; all but the last return the columns they were given.

Edge cases: the operators' own rules hold at each stage. A null or empty text is scored like a text without
terms, is one group with all other empty texts in exact dedup, links with nothing in near dedup, holds no
benchmark passage, and is encoded as no pieces. A null doc_id is judged for toxicity and copies, is never
dropped as a near copy or a leak, and stays null in the result. Of repeated rows exact dedup keeps one. Very
long texts are handled whole. Extra columns, whatever their names, reach the last stage, which returns only
its own. Empty documents, labels or benchmark tables give a result without rows, or without anything rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataflow.llm import decontaminate, exact_dedup, near_dedup, pieces, toxicity
from strataflow.llm.common import Scratch, ended_scratch, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that their nearest labelled examples mark as toxic."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the largest doc_id."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 of five-word shingles: the smallest doc_id."""
    return near_dedup.survivors(docs, near_dedup.Params(words=5, percent=80))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage."""
    return decontaminate.survivors(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The two best segmentations of each text as piece ids, with their scores."""
    return pieces.encode(docs, pieces.load(), n=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("piece_encoding", encode),
]

#: No single SQL statement expresses the learned and hashed stages; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again. What a stage wrote
    for itself goes when its result is written, and a result when the next one is."""
    scratch = Scratch(spark, "pipeline")
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with ended_scratch():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
