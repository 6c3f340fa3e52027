"""Exact deduplication by progressive refinement: length, then a prefix hash, then the full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_sieve, sieve, stored, table

PREFIX_CHARS = 256
#: Lengths that recur are broadcast up to this many rows (8 bytes each); beyond, lengths rule nothing out, the prefixes do.
MOST_LENGTHS = 1 << 20


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Groups of equal texts: text_sha256, keep_id (largest id), group_size, n_keep (rows of that id); a row for each text that recurs.

    1. Rows are counted by byte length. 2. Rows whose length recurs have the hash of their first `prefix_chars` characters
    taken, and are counted by length and prefix. 3. Rows whose length and prefix recur have their full text hashed, and are
    counted by that. What recurs comes back to the scan as a broadcast of bounded size (the lengths, then a sieve of
    prefixes, whose few false hits the full hash sorts out), so texts stay where they are read: only counts and digests
    are shuffled, added up map-side, and a hot length, prefix or text is never gathered in one task. Null texts count as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).select("_id", F.octet_length("_t").cast("long").alias("_len"), "_t")
    lengths = stored(rows.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_len"), "lengths")
    if lengths.count() <= MOST_LENGTHS:
        rows = rows.join(F.broadcast(lengths), "_len", "left_semi")
    key = F.xxhash64("_len", F.substring("_t", 1, prefix_chars))
    prefixes = stored(rows.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"), "prefixes")
    bits, words = sieve(prefixes, F.col("_key"))
    full = rows.where(in_sieve(bits, words, key)).select("_id", F.sha2("_t", 256).alias("text_sha256"))
    by_id = full.groupBy("text_sha256", "_id").agg(F.count(F.lit(1)).alias("_n"))
    groups = by_id.groupBy("text_sha256").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"), F.coalesce(F.max_by("_n", "_id"), F.max("_n")).alias("n_keep"))
    return stored(groups.where("group_size > 1"), "copies")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 for each row.

    Edge cases: a null text equals the empty text; an id that is null is less than any other; rows that repeat both id and
    text all count in group_size and all carry the flag of their id (unique() keeps one of them); a long text is
    hashed like any other; an empty table gives an empty result. Other columns of docs pass through untouched, but
    for those named like results, which are replaced.
    """
    names = ("keep_id", "group_size", "kept", "text_sha256")
    rows = docs.drop(*names).withColumn("text_sha256", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    out = rows.join(refine(docs, id_col, text_col).drop("n_keep"), "text_sha256", "left")
    out = out.withColumn("keep_id", F.coalesce("keep_id", F.col(id_col))).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts: one of the largest id (a null id is less than any other).

    A sieve of the recurring texts' digests lets all other rows pass where they are read; only rows in it meet the groups in a
    join. Where the id that stays repeats with its text, a grouped first, taken map-side first, leaves one of its rows.
    Columns may have any names, as rows travel in a struct. An empty table gives none.
    """
    known = refine(docs, id_col, text_col)
    bits, words = sieve(known, F.xxhash64("text_sha256"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    rows = docs.select(row, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))
    again = in_sieve(bits, words, F.xxhash64("text_sha256"))
    own = F.col(f"_doc.`{id_col}`").eqNullSafe(F.col("keep_id"))
    met = rows.where(again).join(known.select("text_sha256", "keep_id", "n_keep"), "text_sha256", "left").where(F.col("n_keep").isNull() | ((F.col("n_keep") == 1) & own))
    many = rows.where(again).join(known.where("n_keep > 1").select("text_sha256", "keep_id"), "text_sha256").where(own).groupBy("text_sha256").agg(F.first("_doc").alias("_doc"))
    return rows.where(~again).select("_doc").unionByName(met.select("_doc")).unionByName(many.select("_doc")).select("_doc.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = refine(docs)
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")).join(found, "text_sha256", "left")
    keep = F.coalesce("keep_id", "doc_id")
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
