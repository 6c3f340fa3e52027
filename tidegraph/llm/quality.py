"""Quality classifier: ordinal cumulative-link regression on graded ratings, over hashed text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .texts import Words, slices, utf8

GRADES = 3
WORD_BITS = 16
SHAPE_BITS = 10
STEM_BITS = 14
STEM_BYTES = 6
WIDTH = (1 << WORD_BITS) + (1 << SHAPE_BITS) + 1 + (1 << STEM_BITS)
#: Short texts count as having so many words, lest a few words decide.
LEAST_WORDS = 64
#: Labelled rows that the model is fitted on at most, the first by a hash of their id.
SAMPLE_ROWS = 4000
STEPS = 300
RATE = 0.05
RIDGE = 1e-5
#: Documents stay if the probability of the highest grade is at least this.
LEAST_TAIL = 0.5

RESULTS = ("expected_grade", "tail_prob", "kept")

_SHAPE = bytes(48 if 48 <= c < 58 else 65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c >= 128 else c for c in range(256))


def _keys(text: np.ndarray, hash_: np.ndarray, bits: int) -> np.ndarray:
    """The text's number and, below it, so many bits of the hash."""
    return (text.astype(np.int64) << bits) | (hash_ & np.uint64((1 << bits) - 1)).astype(np.int64)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, column, value) of the non-zero features, by text.

    Hashed lower-case words that occur, each 1 / sqrt(how many occur), hashed word shapes (letters, capitals, digits
    and signs, runs drawn together) by their share, the share of words that repeat the one before, and hashed stems (the
    first STEM_BYTES bytes of lower-case words), each log(1 + its count) / 8 whatever the length of the text: a few
    insults count in a long text too, in all their forms.
    """
    words = Words([t.lower() for t in texts], STEM_BYTES)
    key = np.unique(_keys(words.text, words.hash, WORD_BITS))
    row, col = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    val = 1 / np.sqrt(np.maximum(LEAST_WORDS, np.bincount(row, minlength=len(texts))))[row]
    drawn = []
    for t in texts:
        a = np.frombuffer(t.translate(_SHAPE), np.uint8)
        drawn.append(a[np.concatenate(([True], a[1:] != a[:-1]))].tobytes() if len(a) else b"")
    shapes = Words(drawn)
    key, n = np.unique(_keys(shapes.text, shapes.hash, SHAPE_BITS), return_counts=True)
    row2, col2 = key >> SHAPE_BITS, (key & ((1 << SHAPE_BITS) - 1)) + (1 << WORD_BITS)
    val2 = n / np.bincount(row2, weights=n, minlength=len(texts))[row2]
    same = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    again = np.bincount(words.text[1:][same], minlength=len(texts)) / np.maximum(1, np.bincount(words.text, minlength=len(texts)))
    row3, single = np.flatnonzero(again), (1 << WORD_BITS) + (1 << SHAPE_BITS)
    key, n = np.unique(_keys(words.text, words.stem, STEM_BITS), return_counts=True)
    row4, col4 = key >> STEM_BITS, (key & ((1 << STEM_BITS) - 1)) + single + 1
    row, col, val = (np.concatenate(x) for x in ((row, row2, row3, row4), (col, col2, np.full(len(row3), single), col4), (val, val2, again[row3], np.log1p(n) / 8)))
    order = np.argsort(row, kind="stable")
    return row[order], col[order], val[order]


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Ordinal:
    """P(grade <= k) = sigmoid(thresholds[k] - weights . features): one vector of weights, ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        row, col, val = features(texts)
        return np.bincount(row, weights=self.weights[col] * val, minlength=len(texts))


def fit(row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, grades: int = GRADES, steps: int = STEPS) -> Ordinal:
    """Maximum likelihood with a small ridge, by Adam over all rows. Thresholds are a first one and positive gaps."""
    n = len(grade)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n, 0.01, 0.99)
    cuts = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(cuts), 0.1))
    p = np.concatenate((np.zeros(WIDTH), cuts[:1], gaps))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w = p[:WIDTH]
        cut = np.concatenate(([p[WIDTH]], p[WIDTH] + np.cumsum(np.exp(p[WIDTH + 1 :]))))
        score = np.bincount(row, weights=w[col] * val, minlength=n)
        edge = np.concatenate(([-np.inf], cut, [np.inf]))
        up, down = _sigmoid(edge[grade + 1] - score), _sigmoid(edge[grade] - score)
        chance = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / chance, down * (1 - down) / chance
        g_score = d_up - d_down  # of the negative log-likelihood
        g_cut = np.array([np.sum(np.where(grade == k + 1, d_down, 0) - np.where(grade == k, d_up, 0)) for k in range(grades - 1)])
        g = np.concatenate((np.bincount(col, weights=g_score[row] * val, minlength=WIDTH) / n + RIDGE * w, [g_cut.sum() / n], np.exp(p[WIDTH + 1 :]) * np.cumsum(g_cut[::-1])[::-1][1:] / n))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - RATE * 10 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Ordinal(p[:WIDTH], np.concatenate(([p[WIDTH]], p[WIDTH] + np.cumsum(np.exp(p[WIDTH + 1 :])))))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 for toxic, 1 for low quality, 2 for good prose. Repeated labels: the least."""
    known = labels.where("doc_id is not null and quality is not null")
    return known.groupBy("doc_id").agg(F.min(F.when(F.coalesce("toxic", F.lit(0)) == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Ordinal | None:
    """The model, fitted on the driver to at most sample_rows rated rows, which come as features; None without any.

    Documents that repeat a rated id all count with its grade; ratings of ids without a document count for nothing.
    """
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                row, col, val = features(utf8(part.column(1)))
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                spans = list(zip(at, at[1:], strict=False))
                yield pa.record_batch([part.column(0), part.column(2), pa.array([col[a:z].astype(np.int32).tobytes() for a, z in spans]), pa.array([val[a:z].astype(np.float32).tobytes() for a, z in spans])], names=["doc_id", "grade", "cols", "vals"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = sorted(rows.select("doc_id", "text", F.col("grade").cast("int").alias("grade")).mapInArrow(run, f"doc_id {kind}, grade int, cols binary, vals binary").collect())
    if not got:
        return None
    cols = [np.frombuffer(r["cols"], np.int32) for r in got]
    row = np.repeat(np.arange(len(got)), [len(c) for c in cols])
    return fit(row, np.concatenate(cols), np.frombuffer(b"".join(r["vals"] for r in got), np.float32).astype(float), np.array([r["grade"] for r in got]))


def score(docs: DataFrame, model: Ordinal | None, text_col: str = "text") -> DataFrame:
    """docs with expected_grade, tail_prob (the probability of the highest grade) and kept.

    Edge cases: null texts count as empty and have the score of a text without words; bytes that are not UTF-8 count as
    they are; a long text is scored whole, by itself; rows that repeat an id, or have none, are scored each by its own text;
    without a model (no ratings) both numbers are null and every row is kept; columns of docs with these names are
    replaced; an empty table gives none.
    """
    docs = docs.drop(*RESULTS)
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "tail_prob": F.lit(None).cast("double"), "kept": F.lit(True)})
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = utf8(b.column(at))
            s = np.concatenate([shared.value.scores(texts[lo:hi]) for lo, hi in slices(texts)] or [np.empty(0)])
            tails = shared.value.tails(s)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], names=[*b.schema.names, "expected_grade", "tail_prob"])

    schema = T.StructType([*docs.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_prob", T.DoubleType())])
    return docs.mapInArrow(run, schema).withColumn("kept", F.col("tail_prob") >= LEAST_TAIL)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, graded(table(spark, sf_dir, "labels")))
    scored = score(docs, model)
    return scored.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_prob", 6).alias("tail_prob"), "kept")
