"""A training corpus from documents: quality, repeated lines, near copies, mixture, windows.

Each stage gets the documents that the one before kept, and all but the last
return the columns of documents. ``run`` writes each stage's rows to the folder the executors share and
reads them back, so a lost executor costs no more than the running stage.

All stages read whole texts, however long, carry columns beside those of documents along under any names, and give an
empty table for an empty one. What else each does with nulls, blank texts, ties and repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillmill.llm.line_dedup import dedup_lines
from rillmill.llm.ngram_join import keep_one_of_each_group
from rillmill.llm.packing import pack
from rillmill.llm.quality_bayes import quality_documents
from rillmill.llm.shared import cut, read
from rillmill.llm.source_mixing import PRODUCTION, mix


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of quality is at least 0.5; one that is equal to it stays.

    Null and blank texts go, as they have posterior 0. Rows with null ids, sources or languages are judged like others; repeated rows are judged each, alike.
    With fewer than ten labels, or of one class only, the base rate decides.
    """
    return quality_documents(docs, read(spark, sf_dir, "labels"), keep_all=True).drop("posterior").toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines, of 50 characters or more, that occur before; documents with no line left go.

    Rows with null ids or texts stay as they are. Of equal runs the one of the least doc_id and line stays; rows that repeat an id and its text are one document and keep the same lines.
    """
    return dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the least doc_id.

    Rows with null ids, and null or blank texts, are in no group and stay. A similarity equal to the threshold counts. Rows that repeat an id and its text stay or go together; an id with several texts is several documents.
    """
    return keep_one_of_each_group(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; a row for each epoch in which one is taken.

    Null and blank texts have no tokens and aren't taken. A null source or language is a leaf of its own; rows with null ids are taken like others. Documents of equal place in a leaf's seeded order, such as repeated rows,
    are taken together; sources of equal weight and capacity share alike.
    """
    return mix(docs, PRODUCTION, keep_all=True).drop("_domain", "_lang", "_source", "_epoch").toDF(*docs.columns)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each stretch of each document goes, one row for each: every word of every row is placed once.

    Null and blank texts have no words and no row; rows with null ids are placed like others, and repeated rows each. Stretches of equal length are placed by a hash of doc_id, and of windows with equal room the oldest run is filled.
    """
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_copies", near_copies), ("mixture", mixture), ("packing", windows)]

# The first stage has a trained classifier and the last an algorithm over mutable state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
