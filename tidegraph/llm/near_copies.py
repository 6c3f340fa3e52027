"""Near copies: SimHash fingerprints joined by a binary trie, with an exact check of the five-word Jaccard; prefixes find the pairs over the trie's budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, in_sieve, sieve, stored
from .components import connected_components
from .simhash import near_fingerprints, popcount
from .texts import Words, mixed, slices, utf8

SHINGLE_WORDS = 5
#: Least Jaccard, in hundredths.
LEAST = 80
#: Rows whose shingles are counted, and shingles at most that count as common ones. Both bear on the work alone, not on the result.
SAMPLE_ROWS = 16_384
COMMON = 1 << 17
#: Bits in which fingerprints that the trie links may differ.
BUDGET = 3
#: Bits of a row's parities: its shingles by hash, modulo two.
PARITIES = 512
#: Rows of a bucket up to which all its pairs are looked at at once; in a larger one its rows meet pivots first.
WHOLE = 64
#: Rows of a large bucket that meet at a time.
TILE = (256, 2048)
#: Counters of a row's sketch, its shingles by hash: a power of two between these, of so many shingles at most on average if there are enough.
CELLS = (128, 4096)
CELL_SHINGLES = 8


def shingle_sets(texts: list[bytes], k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The distinct 64-bit hashes of each text's runs of k words, A-Z as a-z; a text of fewer words has one, of them all."""
    raw = [t.lower() for t in texts]
    out = []
    for lo, hi in slices(raw):
        words = Words(raw[lo:hi])
        at = 0
        for end in words.last.tolist():
            w, at = words.hash[at:end], end
            n = max(1, len(w) - k + 1)
            h = np.zeros(n, np.uint64)
            for i in range(min(k, len(w))):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
            out.append(np.unique(h))
    return out


def _shingled(rows: DataFrame, text_col: str) -> DataFrame:
    """_row and sh, the shingles."""

    def run(batches):
        for b in batches:
            sets = [s.view(np.int64) for s in shingle_sets(utf8(b.column(1)))]
            yield pa.record_batch([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["_row", "sh"])

    return rows.select("_row", text_col).mapInArrow(run, "_row long, sh array<long>")


def _simhash(s: np.ndarray) -> int:
    """64-bit SimHash of a set of hashes: a bit is 1 if set in over half of them. (A signed long.)"""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(s), 1 << 16):
        ones += np.unpackbits(s[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(s)).tobytes(), "big", signed=True)


def _signed(rows: DataFrame, text_col: str) -> DataFrame:
    """What is known of each row's shingles, of one pass over the texts.

    _row; n, their number; fp, their SimHash; par, their parities by hash modulo PARITIES; c, the sketch; p, the prefix; few, how much of it the smaller row of a pair needs.

    Of two sets with Jaccard >= LEAST / 100 each shares more than n - ceil(n * LEAST / 100) of its n shingles with the
    other, so under any one order of all shingles their first n - ceil(n * LEAST / 100) + 1 have one in common; of the one
    that is not larger the first n - ceil(2 * n * LEAST / (100 + LEAST)) + 1 do. The order puts common shingles last, so
    a line that many texts hold gathers only texts of little else.
    """
    common = _common(rows, text_col)
    by_value = np.argsort(common)
    known = common[by_value]

    def run(batches):
        for b in batches:
            out = []
            for row, s in zip(b.column(0).to_pylist(), shingle_sets(utf8(b.column(1))), strict=True):
                t, n = s.view(np.int64), len(s)
                rank = np.full(n, -1)
                if len(known):
                    at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                    rank = np.where(known[at] == t, by_value[at], -1)
                prefix = t[np.lexsort((t, rank))][: n - -(-n * LEAST // 100) + 1]
                par = np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1).astype(np.uint8)).tobytes()
                out.append((row, n, _simhash(s), par, _sketch(s), prefix, n - -(-2 * n * LEAST // (100 + LEAST)) + 1))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64())
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["_row", "n", "fp", "par", "c", "p", "few"])

    return stored(rows.select("_row", text_col).mapInArrow(run, "_row long, n long, fp long, par binary, c binary, p array<long>, few long"), "signed")


def _sketch(s: np.ndarray) -> bytes:
    """Numbers of the hashes by their last bits, as 32-bit integers. A sketch of more cells folds to one of fewer."""
    least, most = CELLS
    m = min(most, max(least, 1 << (-(-len(s) // CELL_SHINGLES) - 1).bit_length()))
    return np.bincount((s % np.uint64(m)).astype(np.int64), minlength=m).astype("<i4").tobytes()


def _most_shared(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """The most hashes that the sets of each two sketches can share: the lesser of their counts in each cell."""
    lengths = np.array([[len(s) // 4 for s in x], [len(s) // 4 for s in y]], np.int64)
    out = np.zeros(len(x), np.int64)
    for own in np.unique(lengths, axis=1).T:
        at = np.flatnonzero((lengths == own[:, None]).all(axis=0))
        m = int(own.min())
        for k in range(0, len(at), 1024):
            i = at[k : k + 1024]
            folded = [np.frombuffer(b"".join(side[j] for j in i), "<i4").reshape(len(i), -1, m).sum(axis=1) for side in (x, y)]
            out[i] = np.minimum(*folded).sum(axis=1, dtype=np.int64)
    return out


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (stored) less those whose sketches rule LEAST out. Only the sketches of their rows are shuffled, and few others."""

    def run(batches):
        for b in batches:
            same = _most_shared(b.column(4).to_pylist(), b.column(5).to_pylist())
            total = b.column(2).to_numpy() + b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(100 * same >= LEAST * (total - same)))

    bits, words = sieve(pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct(), F.xxhash64("_row"))
    own = sketches.where(in_sieve(bits, words, F.xxhash64("_row")))
    with_a = pairs.join(own.toDF("a", "na", "ca"), "a")
    return with_a.join(own.toDF("b", "nb", "cb"), "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a long, b long")


def _common(rows: DataFrame, text_col: str) -> np.ndarray:
    """Shingles that more than one row of a sample has, the most common last."""
    n = rows.count()
    some = rows if n <= SAMPLE_ROWS else rows.sample(SAMPLE_ROWS / n, seed=7)
    counts = _shingled(some, text_col).select(F.explode("sh").alias("t")).groupBy("t").count().where("count > 1")
    return np.array([r["t"] for r in counts.orderBy(F.desc("count"), "t").limit(COMMON).collect()][::-1], np.int64)


def _by_trie(signed: DataFrame) -> DataFrame:
    """Pairs a, b of each row and the least one that its fingerprint leads to over links within BUDGET."""
    rows = signed.select("_row", "fp")
    linked = connected_components(near_fingerprints(rows.select("fp").distinct(), BUDGET)).select(F.col("node").alias("fp"), "root")
    named = rows.join(linked, "fp", "left").select("_row", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("_row").alias("a"))
    return named.join(least, "root").where("a <> _row").select("a", F.col("_row").alias("b"))


def _buckets(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t, short, _row: recurring shingles of the rows' prefixes; t of those in over WHOLE rows). short: whether t is among the row's first `few`.

    Recurring shingles are found by counts and come back to the rows as a sieve, so a shingle's rows are never gathered:
    each stands in a row of its own.
    """
    index = signed.select("_row", "few", F.posexplode("p").alias("pos", "t")).select("t", (F.col("pos") < F.col("few")).alias("short"), "_row")
    again = stored(index.groupBy("t").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "recurring")
    bits, words = sieve(again, F.col("t"))
    out = stored(index.where(in_sieve(bits, words, F.col("t"))).join(again, "t", "left_semi"), "buckets")
    return out, again.where(F.col("_n") > WHOLE).select("t")


def _able(x: dict, i: np.ndarray, j: np.ndarray, prefixes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i and j of the pairs that can reach LEAST, with the number of parities that differ.

    Sets of n and m shingles share ceil(LEAST * (n + m) / (100 + LEAST)) at least, and no more parities differ than shingles
    do. With prefixes, a pair need only be seen where the shingle is in the short prefix of the smaller row, of both if
    they are of one size.
    """
    n, m = x["n"][i], x["n"][j]
    ok = 100 * np.minimum(n, m) >= LEAST * np.maximum(n, m)
    if prefixes:
        ok &= ((n > m) | x["short"][i]) & ((m > n) | x["short"][j])
    i, j = i[ok], j[ok]
    total = x["n"][i] + x["n"][j]
    differ = popcount(x["par"][i] ^ x["par"][j]).sum(axis=1, dtype=np.int64)
    ok = differ <= total - 2 * -(-LEAST * total // (100 + LEAST))
    return i[ok], j[ok], differ[ok]


def _whole_buckets(batches):
    """Columns by name, of some whole buckets at a time, from batches in the order of t."""
    held: list[dict] = []
    for b in batches:
        x = {k: b.column(k).to_numpy(zero_copy_only=False) for k in b.schema.names if k != "par"}
        x["par"] = np.frombuffer(b"".join(b.column("par").to_pylist()), np.uint64).reshape(-1, PARITIES // 64)
        x["short"] = x["short"].astype(bool)
        last = int(np.searchsorted(x["t"], x["t"][-1])) if len(x["t"]) else 0
        if held and len(x["t"]) and (last or held[-1]["t"][-1] != x["t"][-1]):
            held.append({k: v[:last] for k, v in x.items()})
            yield {k: np.concatenate([h[k] for h in held]) for k in x}
            held = []
        elif last:
            yield {k: v[:last] for k, v in x.items()}
        if len(x["t"]):
            held.append({k: v[last:] for k, v in x.items()})
    if held:
        yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}


def _pairs(x: dict, i: np.ndarray, j: np.ndarray):
    return pa.record_batch([pa.array(x["_row"][i]), pa.array(x["_row"][j])], names=["a", "b"])


def _dealt(buckets: DataFrame, signed: DataFrame, *more: str) -> DataFrame:
    own = buckets.join(signed.select("_row", "n", "par"), "_row").select("t", "_row", "n", "short", "par", *more)
    return own.repartition("t").sortWithinPartitions("t")


def _at_once(buckets: DataFrame, signed: DataFrame) -> DataFrame:
    """All pairs that are able, of buckets of up to WHOLE rows; of larger ones each row and a pivot.

    A pivot is the row nearest to the majority of the parities, as an original is to its copies; rows that are not able
    with it meet another.
    """

    def run(batches):
        for x in _whole_buckets(batches):
            t = x["t"]
            lo = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            size = np.diff(np.append(lo, len(t)))
            small, d = np.repeat(size <= WHOLE, size), 1
            while len(i := np.flatnonzero((t[:-d] == t[d:]) & small[:-d])):
                yield _pairs(x, *_able(x, i, i + d)[:2])
                d += 1
            for k in np.flatnonzero(size > WHOLE):
                rest = np.arange(lo[k], lo[k] + size[k])
                for _ in range(WHOLE):
                    ones = sum(np.unpackbits(x["par"][rest[at : at + 4096]].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) for at in range(0, len(rest), 4096))
                    most = np.packbits(2 * ones > len(rest)).view(np.uint64)
                    pivot = rest[popcount(x["par"][rest] ^ most).sum(axis=1, dtype=np.int64).argmin()]
                    rest = rest[rest != pivot]
                    met = _able(x, np.full(len(rest), pivot), rest, False)[1]
                    yield _pairs(x, np.full(len(met), pivot), met)
                    rest = np.setdiff1d(rest, met, True)
                    if len(rest) < 2:
                        break

    return _dealt(buckets, signed).mapInArrow(run, "a long, b long")


def _across(buckets: DataFrame, large: DataFrame, signed: DataFrame, groups: DataFrame, nearest: bool) -> DataFrame:
    """Pairs of large buckets that are able and in different groups (node, root): all of them, or for each row and tile the nearest."""
    own = buckets.join(large, "t", "left_semi").join(groups.select(F.col("node").alias("_row"), "root"), "_row", "left").withColumn("root", F.coalesce("root", "_row"))
    mixed_ = own.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("t")

    def run(batches):
        for x in _whole_buckets(batches):
            order = np.lexsort((x["root"], x["t"]))
            x = {k: v[order] for k, v in x.items()}
            t, g = x["t"], x["root"]
            lo = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            for first, end in zip(lo.tolist(), [*lo[1:].tolist(), len(t)], strict=True):
                for i0 in range(first, end, TILE[0]):
                    i1 = min(end, i0 + TILE[0])
                    for j0 in range(first if nearest else i0, end, TILE[1]):
                        j1 = min(end, j0 + TILE[1])
                        at, to = np.nonzero(g[i0:i1, None] != g[None, j0:j1])
                        i, j = at + i0, to + j0
                        if not nearest:
                            i, j = i[i < j], j[i < j]
                        i, j, differ = _able(x, i, j)
                        if nearest:
                            by = np.lexsort((differ, i))
                            i, j = i[by], j[by]
                            one = np.concatenate(([True], i[1:] != i[:-1])) if len(i) else np.empty(0, bool)
                            i, j = i[one], j[one]
                        if len(i):
                            yield _pairs(x, i, j)

    return _dealt(own.join(mixed_, "t", "left_semi"), signed, "root").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, rows: DataFrame, sketches: DataFrame, text_col: str) -> DataFrame:
    """Those of the pairs whose Jaccard is LEAST or more."""
    met = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "met")
    pairs = stored(_possible(met, sketches), "pairs")
    drop(met)
    named = pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct()
    sets = stored(_shingled(rows.join(named, "_row", "left_semi"), text_col), "sets")
    both = pairs.join(sets.select(F.col("_row").alias("a"), F.col("sh").alias("x")), "a").join(sets.select(F.col("_row").alias("b"), F.col("sh").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    out = stored(both.where(100 * same >= LEAST * (F.size("x") + F.size("y") - same)).select("a", "b"), "links")
    drop(pairs, sets)
    return out


def near_pairs_connected(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """node, root of the groups that pairs with Jaccard >= LEAST / 100 connect; rows: _row (unique, stored) and text.

    A trie of the SimHash fingerprints links rows within BUDGET; each link is checked by its Jaccard. Fingerprints at
    Jaccard 0.8 differ in some ten bits, so the exact way for the rest goes by prefixes: all pairs of a small bucket, and in
    a large one each row with a pivot, then those still in different groups, nearest first. No pair is left
    out but those that counts of their shingles rule out and those in one group already.
    """
    signed = _signed(rows, text_col)
    buckets, large = _buckets(signed)
    sketches = signed.select("_row", "n", "c")
    links = _verified(_by_trie(signed).unionByName(_at_once(buckets, signed)), rows, sketches, text_col)
    for nearest in (True, False):
        more = _verified(_across(buckets, large, signed, connected_components(links), nearest), rows, sketches, text_col)
        links = links.unionByName(more)
    return connected_components(links)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: the one of the least id, a null id after all others.

    Rows are told apart by a key of their own, so rows with null or repeated ids are judged by their texts like all
    others. Among rows of one id the least SHA-256 of the text stays, of wholly equal ones any. Texts without words
    (null, empty, blank) are near copies of each other. Bytes that are not UTF-8 count as they are; a long text is a set like
    any other. Columns of docs may have any names, as they travel in a struct. An empty table gives none.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    rows = stored(docs.select(row, F.monotonically_increasing_id().alias("_row")), "rows")
    own_id, text = F.col(f"_doc.`{id_col}`"), f"_doc.`{text_col}`"
    groups = near_pairs_connected(rows, text).select(F.col("node").alias("_row"), "root")
    order = F.struct(own_id.isNull().alias("none"), own_id.alias("id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text"), "_row")
    members = rows.select("_row", order.alias("o")).join(groups, "_row")
    best = members.groupBy("root").agg(F.min("o")["_row"].alias("stays"))
    gone = members.select("_row", "root").join(best, "root").where("_row <> stays").select("_row")
    return rows.join(gone, "_row", "left_anti").select("_doc.*")
