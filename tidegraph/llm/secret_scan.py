"""Secret scans over an incremental ledger of blobs: every text version is scanned once for each version of the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_sieve, own_path, sieve, stored, table

RULE_VERSION = "base-1"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")
LEAST_VALUE = 6
#: Elements of an array that are summed at a time.
CHUNK = 128
SPAN = "array<struct<at:bigint,kind:int,until:bigint>>"


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once: an expression within a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums_before(values: Column) -> Column:
    """For each element of an array of longs (a lambda's variable) the sum of those before it, by chunks: work grows little faster than the array."""
    add = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda total, x: total + x)
    before = lambda part: F.transform(part, lambda _, i: add(F.slice(part, F.lit(1), i)))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / CHUNK) - 1, F.lit(0)).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))

    def whole(chunks: Column) -> Column:
        starts = _let(F.transform(chunks, add), before)
        return F.flatten(F.zip_with(starts, chunks, lambda start, part: F.transform(before(part), lambda x: x + start)))

    return _let(cut, whole)


def _spans(text: Column, pattern: str, kind: int, value_group: int | None = None) -> Column:
    """Spans of the matches, in code points, end exclusive.

    Texts between matches and the matches themselves, taken in order with the same pattern, add up to the text; their lengths
    are the places. With a value group, matches whose group is shorter than LEAST_VALUE are dropped after matching.
    ACCESS and HEX are runs taken whole, so their least length stands in the pattern: a shorter run holds no longer match.
    """
    lengths = lambda parts: F.transform(parts, lambda x: F.length(x).cast("bigint"))
    group = lambda g: lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)))
    zipped = F.arrays_zip(lengths(F.split(text, pattern, -1)).alias("gap"), group(0).alias("len"), group(value_group or 0).alias("val"))
    parts = F.filter(zipped, lambda p: p["len"].isNotNull())

    def placed(parts: Column) -> Column:
        before = _let(F.transform(parts, lambda p: p["gap"] + p["len"]), _sums_before)
        return F.zip_with(parts, before, lambda p, b: F.struct((b + p["gap"]).alias("at"), F.lit(kind).alias("kind"), (b + p["gap"] + p["len"]).alias("until"), p["val"].alias("val")))

    found = F.filter(_let(parts, placed), lambda s: s["val"] >= (LEAST_VALUE if value_group else 0))
    spans = F.transform(found, lambda s: F.struct(s["at"].alias("at"), s["kind"].alias("kind"), s["until"].alias("until")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def scan(blobs: DataFrame) -> DataFrame:
    """blob, rule_version, spans for each row (blob, text)."""
    text = F.col("text")
    spans = F.array_sort(F.concat(_spans(text, ASSIGN, 0, 2), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    return blobs.select("blob", F.lit(RULE_VERSION).alias("rule_version"), spans.alias("spans"))


def update_ledger(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan those texts of docs that the ledger at this path doesn't have under RULE_VERSION, add them, and return it.

    A text is addressed by its SHA-256. Of the rows that share one, the smallest id stands for all, chosen by a
    grouped minimum over digests; only those rows' texts reach the scan. A sieve of them, of bounded size, comes back to the
    rows, and what passes it meets them in a join: a run over a known corpus with some new texts shuffles no others. The ledger is a Parquet folder in shared storage to which each call appends; a call that is lost
    leaves no files, as Spark commits the whole write.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    unseen = rows.groupBy("blob").agg(F.min("_id").alias("_id"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        have = spark.read.parquet(ledger)
        unseen = unseen.join(have.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    unseen = stored(unseen, "unseen")
    key = F.xxhash64("blob", "_id")
    bits, words = sieve(unseen, key)
    # rows of a blob that repeat its smallest id are equal in text: any of them will do, so they are scanned alike and met again by distinct()
    same = rows["_id"].eqNullSafe(unseen["_id"]) & (rows["blob"] == unseen["blob"])  # a text may have no row with an id
    todo = rows.where(in_sieve(bits, words, key)).join(unseen.hint("shuffle_hash"), same, "left_semi").select("blob", "text")
    scan(todo).withColumn("spans", F.transform("spans", lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["at"], s["until"]))).distinct().write.mode("append").option("compression", "zstd").parquet(ledger)
    return spark.read.parquet(ledger).where(F.col("rule_version") == RULE_VERSION)


def secret_scan(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id with blob and spans (array of kind:start:end) of each row, findings joined back to every copy of a text.

    Edge cases: a null text is the empty text; texts without findings have an empty array; repeated rows, and rows of a
    repeated or null id, each get a row with their own text's findings; spans that start alike stand in the order of KINDS;
    a long text with many matches is worked off in chunks; columns of docs besides id and text play no part; an empty
    table gives none.
    """
    found = update_ledger(docs, ledger, id_col, text_col).where(F.size("spans") > 0).select("blob", "spans")
    rows = docs.select(id_col, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    return rows.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<string>")))


def _count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.startswith(f"{kind}:"))).cast("long")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty ledger, a new folder in the shared one that goes at exit. This method adds no spans to the base ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("spans")
    count = [_count_of(spans, k).alias(f"n_{k}") for k in KINDS]
    joined = F.array_join(spans, ",")
    return secret_scan(docs, own_path(spark, "ledger")).select("doc_id", *count, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def _sql_spans(kind: int, pattern: str, value_group: int | None) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {kind} AS kind,
         list_transform(range(1, len(found) + 1), lambda i: coalesce(list_sum(list_transform(gaps[:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(found[:i - 1], lambda g: length(g))), 0)) AS places,
         found, vals
  FROM (SELECT doc_id, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}') AS found, regexp_extract_all(t, '{quoted}', {value_group or 0}) AS vals FROM d)"""


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_sql_spans(0, ASSIGN, 2)} UNION ALL {_sql_spans(1, ACCESS, None)} UNION ALL {_sql_spans(2, HEX, None)}),
s AS (
  SELECT doc_id, kind, unnest(places) AS place, unnest(found) AS found, unnest(vals) AS val FROM m),
o AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || place::BIGINT || ':' || (place + length(found))::BIGINT, ',' ORDER BY place, kind) AS spans
  FROM s WHERE kind > 0 OR length(val) >= {LEAST_VALUE} GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN o USING (doc_id)
"""
