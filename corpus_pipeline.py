"""A corpus pipeline: quality rules, line dedup, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``; where a stage changes a text, ``n_chars`` follows it.
Stages take extra columns of any name and tables without rows; what they do with
nulls, empty and repeated rows is said by the operators they call.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import differencing, line_windows, private_spans, robust_outliers, size_aware_join
from tallybook.llm.common import read, stored


def _changed(docs: DataFrame, before: DataFrame) -> DataFrame:
    """``docs`` in the columns of ``before``, with ``n_chars`` of the texts as they are now."""
    if "n_chars" in before.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))
    return docs.select(*before.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules."""
    return robust_outliers.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of three lines."""
    return _changed(line_windows.remove_repeated(docs), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of the smallest id;
    documents without an id are no copies of any. Of rows that repeat an id as well
    as a text one stays."""
    return size_aware_join.representatives(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _changed(private_spans.redact(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie in which sequence."""
    return differencing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality), ("line dedup", lines), ("near copies", near_copies), ("personal data", private), ("packing", packing),
]

#: Robust estimates, boosted trees and differencing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
