"""What the operators of this subpackage share: tables, the shared scratch folder, word splitting."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that part words, as a set for trimming and as a regular expression.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

#: Bits of a sieve for each of its keys unless a caller asks for more, and the longest sieve in 64-bit words: 8 MB.
SIEVE_BITS = 16
MOST_SIEVE_WORDS = 1 << 20

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset (tests), a folder of our own."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = f"file://{tempfile.mkdtemp(prefix='tidegraph-')}"
    return _own_dir


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended by now
            pass


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes at exit."""
    path = f"{shared_dir(spark)}/tidegraph-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lost executors cost no recomputation beyond this table.

    The driver then lets go of shuffle files that no plan needs any more. The table goes with drop() or at exit.
    """
    spark = df.sparkSession
    path = own_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return back


def drop(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and that no later step reads."""
    for t in tables:
        if path := getattr(t, "stored_at", None):
            _delete(t.sparkSession, path)


def n_words(text: Column) -> Column:
    """The number of words `[^\\x20\\x09-\\x0D]+`; null counts as empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANK_RUN, -1))).cast("long")


def word_list(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` in order; null counts as empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN, -1))


def clean_text(text: Column) -> Column:
    """The text for Python stages: null counts as empty, bytes that are not UTF-8 as U+FFFD."""
    return F.make_valid_utf8(F.coalesce(text, F.lit("")))


def sieve(keys: DataFrame, key: Column, bits_a_key: int = SIEVE_BITS) -> tuple[Column, int]:
    """(an array of words with a bit for each key, a long, as a scalar subquery; the number of words).

    A bit table of bounded size: what it rejects is not among the keys; what it lets through may be.
    """
    n = max(1, keys.count())
    words = 1 << min(MOST_SIEVE_WORDS.bit_length() - 1, max(0, (n * bits_a_key // 64 - 1).bit_length()))
    place = key.bitwiseAND(F.lit(words * 64 - 1))
    bits = keys.select(F.shiftright(place, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(words).withColumnRenamed("id", "at").join(bits, "at", "left").select("at", F.coalesce("bits", F.lit(0)).alias("bits"))
    return every.agg(F.sort_array(F.collect_list(F.struct("at", "bits")))["bits"].alias("words")).scalar(), words


def in_sieve(bits: Column, words: int, key: Column) -> Column:
    """Whether the key's bit is set: always for the keys themselves, else seldom."""
    place = key.bitwiseAND(F.lit(words * 64 - 1))
    return F.call_function("shiftrightunsigned", F.get(bits, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
