"""A corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents.

Every stage takes rows with nulls in any column, repeated rows and ids, texts of any length, further columns of any name,
and empty tables; all but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.byte_bpe import token_digests
from tidegraph.llm.common import stored, table
from tidegraph.llm.exact_dedup import unique
from tidegraph.llm.mixing import mix
from tidegraph.llm.near_copies import without_near_copies
from tidegraph.llm.quality import RESULTS, graded, score, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on rated documents among docs; those that it rejects go. Texts that are null or empty are scored as texts without words."""
    own = docs.toDF(*(f"doc column {i}" if c in RESULTS else c for i, c in enumerate(docs.columns)))  # names of results are theirs for a while
    return score(own, train(docs, graded(table(spark, sf_dir, "labels")))).where("kept").select(*own.columns).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one document of the largest id stays, a null id after all others; wholly equal rows are cut down to one."""
    return unique(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard 0.8 or more), the document of the smallest id stays, a null id after all others."""
    return without_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a document comes once for each epoch that takes words of it, with these.

    Texts without words are never taken; a null source is one of its own; repeated rows count as often as they occur.
    """
    return mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text of each mixed document; a null text has no tokens."""
    return token_digests(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near-dedup", near), ("mixing sources", mixed), ("byte-level BPE", encoded)]

#: SQL has no XXH64 and no byte-pair encoder: none. tests/llm holds run() against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
