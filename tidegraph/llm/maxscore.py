"""Exact top-k search by inner product over quantised vectors: MaxScore over shards, merged by a window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SCALE = 64
TOP_K = 20
SHARD_ROWS = 16384
QUERY_ROWS = 512
#: Blocks of queries that meet a shard in one task.
MEETING_BLOCKS = 2
#: Candidates of a shard that are scored between two updates of the thresholds.
STEP_ROWS = 2048
#: Non-essential terms that are probed between two looks at what is still competitive.
PROBE_TERMS = 4
#: Partitions of the meetings at most; beyond, one takes several meetings, one after another.
MOST_PARTITIONS = 20_000


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """row, id and x of the vectors that are whole: not null, without nulls, NaN or infinities. Rows are told apart by `row`, so ids may repeat."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(finite)
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x")), "vectors")


def _postings(lists: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) by component: row j is the posting list of component j, a value for each vector, short vectors filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((int(sizes.max(initial=0)), len(sizes)))
    vector = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), vector] = flat
    return out


def _smallest(m: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest kind that holds them."""
    top = float(np.abs(m).max(initial=0))
    return m.astype("<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8")


def maxscore(q_row: np.ndarray, q: np.ndarray, row: np.ndarray, ids: np.ndarray, postings: np.ndarray, k: int = TOP_K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the query, candidate id, score) of each query's k best candidates but its own row, ties to the smaller id. Exact.

    q: a row for each query, a column for each term. postings: a row for each term, a column for each candidate. A
    query's terms are ranked by their score bound in this shard. The longest run of the lowest bounds whose sum stays
    below the query's k-th score so far is non-essential: no candidate gets there by these terms alone. Step by step
    through the candidates, the essential terms' postings are traversed; then each candidate's other terms are probed, the
    highest bound first, as long as its score plus the bound of what is left (the lesser of the terms' bounds and the product
    of both sides' norms over the non-essential terms) reaches the threshold. Thresholds, and with them the split, move with
    every step; candidates of large norm come first, so that they rise early. Before k candidates are known every term
    is essential.
    """
    width = max(q.shape[1], len(postings))
    q, d = np.pad(q, ((0, 0), (0, width - q.shape[1]))), np.pad(postings, ((0, width - len(postings)), (0, 0)))
    if float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(width, 1) >= 2**53:
        return _by_integers(q_row, q, row, ids, d.T, k)
    order = np.argsort(-np.einsum("ij,ij->j", d, d), kind="stable")
    row, ids, d = row[order], ids[order], d[:, order]
    bound = np.maximum(q * d.max(axis=1, initial=0), q * d.min(axis=1, initial=0))
    by_bound = np.argsort(bound, axis=1, kind="stable")
    place = np.argsort(by_bound, axis=1)
    lowest = np.concatenate((np.zeros((len(q), 1)), np.cumsum(np.take_along_axis(bound, by_bound, axis=1), axis=1)), axis=1)  # of so many lowest bounds: the sum
    best_s = np.full((len(q), k), -np.inf)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    theta = np.full(len(q), -np.inf)
    every = np.arange(len(q))
    for at in range(0, d.shape[1], STEP_ROWS):
        lists, here, its = d[:, at : at + STEP_ROWS], ids[at : at + STEP_ROWS], row[at : at + STEP_ROWS]
        spare = (lowest[:, 1:] < theta[:, None]).sum(axis=1)  # non-essential terms of each query
        essential = place >= spare[:, None]
        part = np.where(essential, q, 0) @ lists
        rest = np.sqrt(np.where(essential, 0, q * q).sum(axis=1)[:, None] * ((~essential).astype(float) @ (lists * lists))) * (1 + 1e-12) + 1e-9
        rest = np.minimum(rest, lowest[every, spare][:, None])
        rows, cols = np.nonzero(part + rest >= theta[:, None])
        scores, left = part[rows, cols], spare[rows]
        while len(left) and (most := int(left.max())) > 0:
            for _ in range(min(PROBE_TERMS, most)):
                left = left - 1
                term = by_bound[rows, np.maximum(left, 0)]
                scores = scores + np.where(left >= 0, q[rows, term] * lists[term, cols], 0)
            left = np.maximum(left, 0)
            fit = scores + lowest[rows, left] >= theta[rows]
            rows, cols, scores, left = rows[fit], cols[fit], scores[fit], left[fit]
        fit = (scores >= theta[rows]) & (its[cols] != q_row[rows])
        rows, cols, scores = rows[fit], cols[fit], scores[fit]
        if not len(rows):
            continue
        touched, first = np.unique(rows, return_index=True)
        for r, lo, hi in zip(touched.tolist(), first.tolist(), np.append(first[1:], len(rows)).tolist(), strict=True):
            s = np.concatenate((best_s[r], scores[lo:hi]))
            i = np.concatenate((best_i[r], here[cols[lo:hi]]))
            top = np.lexsort((i, -s))[:k]
            best_s[r], best_i[r] = s[top], i[top]
            theta[r] = best_s[r, -1]
    found = best_s > -np.inf
    return np.nonzero(found)[0], best_i[found], best_s[found].astype(np.int64)


def _by_integers(q_row, q, row, ids, d, k):
    """The same for values whose sums leave the exact range of doubles: Python integers; scores are held to 64 bits."""
    out = ([], [], [])
    a, b = ([[int(x) for x in one] for one in m.tolist()] for m in (q, d))
    for n, (own, one) in enumerate(zip(q_row.tolist(), a, strict=True)):
        scored = sorted((-sum(x * y for x, y in zip(one, other, strict=True)), j) for i, j, other in zip(row.tolist(), ids.tolist(), b, strict=True) if i != own)[:k]
        for s, j in scored:
            out[0].append(n)
            out[1].append(j)
            out[2].append(max(-(2**63), min(2**63 - 1, -s)))
    return tuple(np.array(x, np.int64) for x in out)


def top_k(vectors: DataFrame, is_query, k: int = TOP_K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best among all other rows. is_query: a condition on column `id`.

    Candidates are packed into shards of about SHARD_ROWS rows and queries into blocks of about QUERY_ROWS, a row each.
    Every block meets every shard, MEETING_BLOCKS blocks at a time: shards are copied once for that many blocks, blocks
    once a shard, and the key of a meeting is the shard and the group of blocks. A meeting holds one shard and its blocks,
    and returns at most k rows a query. Edge cases: vectors that usable() rejects take no part; vectors of unequal length
    count as filled with zeros; rows that repeat an id are candidates and queries each, and candidates for one another;
    ties go to the smaller id; columns of other names play no part; an empty table, or no query, gives no rows.
    """
    rows = usable(vectors, id_col, vec_col)
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    groups = -(-blocks // MEETING_BLOCKS)

    def pack(t: pa.Table) -> pa.Table:
        m = _smallest(_postings(t.column("x"), scale))
        as_bytes = lambda c: t.column(c).to_numpy().astype("<i8").tobytes()
        return pa.table({"part": t.column("part").slice(0, 1), "rows": [as_bytes("row")], "ids": [as_bytes("id")], "kind": [m.dtype.str], "m": pa.array([m.tobytes()], pa.binary())})

    packed = "part int, rows binary, ids binary, kind string, m binary"
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("part")
    d = rows.select(part(shards), "row", "id", "x").groupBy("part").applyInArrow(pack, packed)
    q = rows.where(is_query).select(part(blocks), "row", "id", "x").groupBy("part").applyInArrow(pack, packed)
    partitions = min(shards * groups, MOST_PARTITIONS)
    d = d.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumnRenamed("part", "shard").repartition(partitions, "shard", "group")
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("group", F.floor(F.col("part") / MEETING_BLOCKS).cast("int")).repartition(partitions, "shard", "group")

    def unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, ids = np.frombuffer(r["rows"], "<i8"), np.frombuffer(r["ids"], "<i8")
        return row, ids, np.frombuffer(r["m"], r["kind"]).astype(float).reshape(-1, len(row))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        for shard in left.to_pylist():
            row, ids, postings = unpacked(shard)
            for block in right.to_pylist():
                q_row, q_ids, q_terms = unpacked(block)
                at, found, scores = maxscore(q_row, q_terms.T, row, ids, postings, k)
                for c, x in zip(out, (q_row[at], q_ids[at], found, scores), strict=True):
                    c.append(x)
        return pa.table({name: np.concatenate([np.empty(0, np.int64), *x]) for name, x in zip(("row", "query_id", "vec_id", "score"), out, strict=True)})

    found = d.groupBy("shard", "group").cogroup(q.groupBy("shard", "group")).applyInArrow(search, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)


OP4_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (
  SELECT q.own, q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.x, d.x), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.own <> d.own)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY own ORDER BY score DESC, vec_id)
QUALIFY rank <= 20
"""
