"""SimHash near-deduplication: fingerprints, a binary-trie self-join within a Hamming budget, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .components import connected_components
from .texts import utf8

SHINGLE_WORDS = 3
BUDGET = 2
#: The fingerprint is cut into BUDGET + 2 blocks; two fingerprints within the budget agree in two of them at least.
BLOCKS = BUDGET + 2
#: Node pairs that one step of the trie traversal expands at a time.
STEP_PAIRS = 1 << 19
#: Fingerprints that a task holds before it joins the tries it has whole; a single larger trie is held whole.
HELD_KEYS = 1 << 20


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a UTF-8 text's word shingles, repeats included, over XXH64 with seed 42. No words: 0."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    n = len(words) - k + 1
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of each row. Bytes that are not UTF-8 count as they are."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_links(keys: np.ndarray, fixed_bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of the sorted distinct uint64 keys that agree in the first fixed_bits and differ in 1 to budget of the rest.

    The sorted keys are a binary trie whose nodes are intervals. Pairs of nodes of one depth go down together: equal
    branches keep the count of differing bits, unequal ones add one, and a pair over the budget is dropped with all
    below it. Pairs are expanded in arrays of at most STEP_PAIRS, depth first.
    """
    n = len(keys)
    none = np.empty(0, np.int64)
    if n < 2:
        return none, none
    if fixed_bits:
        top = keys >> np.uint64(64 - fixed_bits)
        lo = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
        hi = np.append(lo[1:], n)
    else:
        lo, hi = np.array([0]), np.array([n])
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(fixed_bits, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    out_i, out_j = [], []
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > STEP_PAIRS:
            half = len(a0) // 2
            stack += [(depth, a0[half:], a1[half:], b0[half:], b1[half:], err[half:]), (depth, a0[:half], a1[:half], b0[:half], b1[:half], err[:half])]
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = (i != j) & (popcount(keys[i] ^ keys[j]) <= budget)
            out_i.append(i[near])
            out_j.append(j[near])
            a0, a1, b0, b1, err = (x[~single] for x in (a0, a1, b0, b1, err))
        if not len(a0) or depth == 64:
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        am, bm = _split(keys, a0, a1, bit), _split(keys, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        parts = [
            (a0, am, b0, bm, err),
            (am, a1, bm, b1, err),
            (a0, am, bm, b1, err + 1),
            tuple(x[~same] for x in (am, a1, b0, bm, err + 1)),
        ]
        c0, c1, d0, d1, e = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (c1 > c0) & (d1 > d0) & (e <= budget) & ~((c0 == d0) & (c1 - c0 == 1))
        if live.any():
            stack.append((depth + 1, c0[live], c1[live], d0[live], d1[live], e[live]))
    if not out_i:
        return none, none
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    return np.minimum(i, j), np.maximum(i, j)


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Of each interval, whose keys agree above this bit: the first place where the bit is set."""
    ones = np.concatenate(([0], np.cumsum((keys & bit) != 0)))
    return hi - (ones[hi] - ones[lo])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least place that the links reach."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def _block_order(chosen: tuple[int, ...], blocks: int) -> list[tuple[int, int]]:
    """(first bit from the left, width) of all blocks, the chosen ones first."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    spans = [(edge[k], edge[k + 1] - edge[k]) for k in range(blocks)]
    return [spans[k] for k in chosen] + [s for k, s in enumerate(spans) if k not in chosen]


def turned(keys: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The keys with their blocks in another order."""
    out = np.zeros_like(keys)
    for at, width in order:
        out = (out << np.uint64(width)) | ((keys >> np.uint64(64 - at - width)) & np.uint64((1 << width) - 1))
    return out


def near_fingerprints(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links a, b that connect all fingerprints (column fp, distinct) that differ in at most budget bits.

    Every choice of two of the budget + 2 blocks has a trie of its own, in which those blocks come first and must be
    equal; each pair within the budget meets in one of them at least. The tries are dealt out by the equal blocks'
    bits and come to a task in their order, so that it holds some at a time. It joins them with themselves and returns, in
    place of all pairs, a link from each fingerprint to the least one that it is connected to.
    """
    blocks = budget + 2
    choices = list(combinations(range(blocks), 2))

    def deal(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for c, chosen in enumerate(choices):
                order = _block_order(chosen, blocks)
                t = turned(keys, order)
                top = t >> np.uint64(64 - order[0][1] - order[1][1])
                yield pa.record_batch([pa.array(np.full(len(t), c, np.int32)), pa.array(top.view(np.int64)), pa.array(t.view(np.int64))], names=["c", "top", "t"])

    def links(c: int, t: np.ndarray):
        order = _block_order(choices[c], blocks)
        keys = np.unique(t)
        i, j = trie_links(keys, order[0][1] + order[1][1], budget)
        root = _roots(len(keys), i, j)
        moved = np.flatnonzero(root != np.arange(len(keys)))
        back = _inverse(order)
        return pa.record_batch([pa.array(turned(keys[moved], back).view(np.int64)), pa.array(turned(keys[root[moved]], back).view(np.int64))], names=["a", "b"])

    def join(batches):
        """Tries come one after another; whole ones are joined as soon as HELD_KEYS fingerprints are there."""
        held: dict[int, list] = {}
        n = 0
        for b in batches:
            c_all, top_all, t_all = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)
            ends = np.flatnonzero((c_all[1:] != c_all[:-1]) | (top_all[1:] != top_all[:-1])) + 1
            at = 0
            for end in [*ends.tolist(), len(c_all)]:
                here = (int(c_all[at]), int(top_all[at]))
                if n >= HELD_KEYS and here != last:
                    for c, parts in held.items():
                        yield links(c, np.concatenate(parts))
                    held, n = {}, 0
                held.setdefault(here[0], []).append(t_all[at:end])
                n, at, last = n + end - at, end, here
        for c, parts in held.items():
            yield links(c, np.concatenate(parts))

    dealt = fps.select("fp").mapInArrow(deal, "c int, top long, t long")
    return dealt.repartition("c", "top").sortWithinPartitions("c", "top").mapInArrow(join, "a long, b long")


def _inverse(order: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The order that turns blocks in the given order back."""
    at, places = 0, []
    for first, width in order:
        places.append((first, at, width))
        at += width
    return [(now, width) for _, now, width in sorted(places)]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, budget: int = BUDGET) -> DataFrame:
    """id, fp, component_id (the least id of the near-duplicate group) of each row.

    Edge cases: null, empty and blank texts have fingerprint zero and form one group with whatever is within the
    budget of it; bytes that are not UTF-8 count as they are; long texts are hashed in pieces of 65,536 shingles; rows that
    repeat an id, with whatever text, each have their row, and the id counts for each group they are in; rows without an id have a
    row, but name a group only where none of its rows has one; columns of docs besides id and text play no part; an
    empty table gives none.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min(id_col).alias("_least"))
    linked = connected_components(near_fingerprints(distinct, budget)).select(F.col("node").alias("fp"), "root")
    known = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("_least").alias("component_id"))
    return rows.join(known.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp")


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
