"""Substring deduplication: repeated windows of words, found with sharded Aho-Corasick automata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stored, table
from .texts import Words, mixed, slices, utf8

WINDOW = 20
#: Words of an anchor, the phrase by which windows meet.
ANCHOR = 6
SHARD_BYTES = 4 << 20
#: Anchors that occur more often send their windows one by one, dealt by the windows' own hashes.
HOT_ANCHOR = 20_000
#: Words of the pieces for which one automaton is compiled.
AUTOMATON_WORDS = 400_000


def _slide(x: np.ndarray, span: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each span neighbours."""
    have = 1
    while have < span:
        step = min(have, span - have)
        x = pick(x[: len(x) - step], x[step:])
        have += step
    return x


def _phrase_hashes(words: Words, anchor: int) -> np.ndarray:
    m = max(0, len(words) - anchor + 1)
    g = words.hash[:m].copy()
    for j in range(1, anchor):
        g = g * np.uint64(0x5851F42D4C957F2D) + words.hash[j : m + j]
    return mixed(g)


def window_anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words of the windows, anchor hash of each): the least hash of the anchor-long phrases within a window.

    Equal windows have equal anchors; about two in window - anchor + 2 phrases are one.
    """
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = _slide(_phrase_hashes(words, anchor), window - anchor + 1, np.minimum)
    first = np.flatnonzero(np.arange(n) + window <= words.last[words.text[:n]])
    return first, g[first]


def anchor_places(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of all phrases that are an anchor of some window."""
    first, h = window_anchors(words, window, anchor)
    if not len(first):
        return first, h
    g = _phrase_hashes(words, anchor)
    span = window - anchor + 1
    least = np.zeros(len(g) + span - 1, np.uint64)  # of the window that starts span - 1 words before, zero where there is none
    least[first + span - 1] = h
    at = np.flatnonzero(_slide(least, span, np.maximum) == g)
    return at, g[at]


def anchor_runs(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of each run of neighbouring windows of one text with one anchor."""
    first, h = window_anchors(words, window, anchor)
    if not len(first):
        return first, first, h
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (first[1:] != first[:-1] + 1) | (words.text[first[1:]] != words.text[first[:-1]])))
    at = np.flatnonzero(new)
    return first[at], np.diff(np.append(at, len(first))), h[at]


def _split_rows(key: np.ndarray, *columns: np.ndarray):
    """(key, columns' rows with this key), by key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else []
    for a, b in zip(at, [*at[1:], len(key)], strict=True):
        yield int(key[a]), [c[order[a:b]] for c in columns]


class _Letters(dict):
    """A character for each word, in order of appearance."""

    def __missing__(self, word):
        c = self[word] = chr(len(self))
        return c


def _recurring(strings: list[str], window: int) -> list[tuple[int, int]]:
    """(string, place) of the first of each run of equal window hashes that occurs more than once: hashed counts, no letters compared."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    g = mixed(np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))
    m = len(g) - window + 1
    if m < 2:
        return []
    h = g[:m].copy()
    for j in range(1, window):
        h = h * np.uint64(0x5851F42D4C957F2D) + g[j : m + j]
    ends, of = np.cumsum(sizes), np.repeat(np.arange(len(strings)), sizes)
    first = np.flatnonzero(np.arange(m) + window <= ends[of[:m]])
    _, at, times = np.unique(h[first], return_index=True, return_counts=True)
    at = first[np.sort(at[times > 1])]
    return list(zip(of[at].tolist(), (at - (ends - sizes)[of[at]]).tolist(), strict=True))


def locate(pieces: list[tuple[tuple, int, int, bytes]], window: int) -> list[tuple[tuple, int, int]]:
    """(doc, first window, number of windows) of the runs of windows that also start earlier.

    pieces: (doc, first window, number of windows, text), in order of place; any two equal windows of the corpus are
    both among them, but for those that a shard has dropped itself. Windows whose hash recurs among the pieces are compiled
    into an automaton, a letter for each word, each with the place where it starts first. All pieces stream through
    it: what it finds is equal word by word, so a window whose hash alone recurs is found at its own place and stays.
    """
    import ahocorasick

    letters = _Letters()
    strings = ["".join(map(letters.__getitem__, text.split())) for *_, text in pieces]
    again = _recurring(strings, window)
    if not again:
        return []
    automaton = ahocorasick.Automaton()
    for k, i in again:
        doc, at, *_ = pieces[k]
        automaton.add_word(strings[k][i : i + window], (doc, at + i))
    automaton.make_automaton()
    out = []
    for (doc, at, n, _), s in zip(pieces, strings, strict=True):
        run = None
        for end, where in automaton.iter(s):
            i = at + end - window + 1
            if where != (doc, i):
                if run and run[1] + run[2] == i:
                    run[2] += 1
                else:
                    if run:
                        out.append(tuple(run))
                    run = [doc, i, 1]
        if run:
            out.append(tuple(run))
    return out


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, hot_anchor: int = HOT_ANCHOR) -> tuple[DataFrame, int]:
    """(id, h, start, n: runs of windows to remove; number of shards). A document is an id with a text, h the text's hash.

    1. Each text's anchors are counted for every shard of documents, packed, and added up by anchor.
    2. Shards learn which of their anchors recur, and send the text around those, a piece for each run of windows, to
       the bucket of the anchor. A shard sends equal pieces once; what repeats within it, it marks itself.
    3. Each bucket confirms its repeated windows, compiles automata and streams its pieces through them.
    A document meets only the automata that can hold a phrase of it, so work grows with the corpus, not with documents
    times automata; a passage in a third of all documents costs its bucket one piece a shard.
    """
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col).where(F.col("id").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    rows = rows.withColumn("shard", _shard(shards))

    def count(batches):
        for b in batches:
            texts = utf8(b.column(0))
            shard_of = b.column(1).to_numpy()
            for lo, hi in slices(texts):
                words = Words(texts[lo:hi])
                at, h = anchor_places(words, window, ANCHOR)
                if not len(h):
                    continue
                shard = shard_of[lo:hi][words.text[at]]
                order = np.lexsort((h, shard))
                h, shard = h[order], shard[order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (shard[1:] != shard[:-1]))))
                times = np.diff(np.append(new, len(h)))
                h, shard = h[new], shard[new]
                out = [(k, x.tobytes(), y.astype(np.int32).tobytes(), z.astype(np.int32).tobytes()) for k, (x, y, z) in _split_rows((h % np.uint64(shards)).astype(np.int64), h, shard, times)]
                yield pa.record_batch([pa.array(c) for c in ([r[0] for r in out], [r[1] for r in out], [r[2] for r in out], [r[3] for r in out])], schema=counted)

    counted = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("shard", pa.binary()), ("times", pa.binary())])
    counts = rows.select("text", "shard").mapInArrow(count, "bucket int, h binary, shard binary, times binary")

    def recurring(t: pa.Table) -> pa.Table:
        h, shard, times = (np.frombuffer(b"".join(t.column(c).to_pylist()), k) for c, k in (("h", np.uint64), ("shard", np.int32), ("times", np.int32)))
        order = np.argsort(h, kind="stable")
        h, shard, times = h[order], shard[order], times[order]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
        sums = np.repeat(np.add.reduceat(times.astype(np.int64), at), np.diff(np.append(at, len(h)))) if len(h) else times
        many = sums > 1
        out = [(k, x.tobytes(), y.tobytes()) for k, (x, y) in _split_rows(shard[many], h[many], sums[many] > hot_anchor)]
        return pa.table({"shard": pa.array([r[0] for r in out], pa.int32()), "h": pa.array([r[1] for r in out], pa.binary()), "hot": pa.array([r[2] for r in out], pa.binary())})

    known = stored(counts.groupBy("bucket").applyInArrow(recurring, "shard int, h binary, hot binary"), "anchors")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [], [], [])

        def put(*row):
            for c, x in zip(out, row, strict=True):
                c.append(x)

        h_known = np.frombuffer(b"".join(right.column("h").to_pylist()), np.uint64)
        hot_known = np.frombuffer(b"".join(right.column("hot").to_pylist()), bool)
        h_known, where = np.unique(h_known, return_index=True)
        hot_known = hot_known[where]
        if len(h_known) and left.num_rows:
            docs_here = sorted(set(zip(left.column("id").to_pylist(), left.column("h").to_pylist(), utf8(left.column("text")), strict=True)))
            texts, seen = [t for *_, t in docs_here], set()
            for lo, hi in slices(texts):
                words = Words(texts[lo:hi])
                first, n, h = anchor_runs(words, window, ANCHOR)
                place = np.minimum(np.searchsorted(h_known, h), len(h_known) - 1)
                on = np.flatnonzero(h_known[place] == h)
                text_first = np.concatenate(([0], words.last[:-1]))
                for f, k, a, hot, d in zip(first[on].tolist(), n[on].tolist(), h[on].tolist(), hot_known[place[on]].tolist(), words.text[first[on]].tolist(), strict=True):
                    at = f - int(text_first[d])
                    for i, m in [(i, 1) for i in range(k)] if hot else [(0, k)]:
                        piece = words.data[words.start[f + i] : words.end[f + i + m - 1 + window - 1]]
                        if piece in seen:
                            put(None, *docs_here[lo + d][:2], at + i, m, None, None)
                            continue
                        seen.add(piece)
                        key = int(mixed(np.bitwise_xor.reduce(words.hash[f + i : f + i + window] * np.arange(1, 2 * window, 2, dtype=np.uint64), keepdims=True))[0]) if hot else a
                        put(key % shards, *docs_here[lo + d][:2], at + i, m, key - (1 << 63), piece)
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "id", "h", "start", "n", "anchor", "piece"])

    pieces = stored(rows.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(cut, "bucket int, id long, h long, start int, n int, anchor long, piece binary"), "pieces")
    drop(known)

    def find(t: pa.Table) -> pa.Table:
        t = t.sort_by([("anchor", "ascending"), ("id", "ascending"), ("h", "ascending"), ("start", "ascending")])
        anchor = t.column("anchor").to_numpy()
        n = t.column("n").to_numpy()
        ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
        size = np.concatenate(([0], np.cumsum(n + window - 1)))
        out, at = [], 0
        for k, end in enumerate(ends.tolist()):
            if end == len(anchor) or size[ends[k + 1]] - size[at] > AUTOMATON_WORDS:
                part = t.slice(at, end - at)
                if part.num_rows > 1 or n[at] > 1:
                    part = part.sort_by([("id", "ascending"), ("h", "ascending"), ("start", "ascending")])
                    own = zip(part.column("id").to_pylist(), part.column("h").to_pylist(), strict=True)
                    out += locate(list(zip(own, *(part.column(c).to_pylist() for c in ("start", "n", "piece")), strict=True)), window)
                at = end
        flat = [(*doc, at, n) for doc, at, n in out]
        return pa.table({c: pa.array([r[i] for r in flat], k) for i, (c, k) in enumerate((("id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("n", pa.int32())))})

    elsewhere = pieces.where("bucket is not null").groupBy("bucket").applyInArrow(find, "id long, h long, start int, n int")
    own = pieces.where("bucket is null").select("id", "h", "start", "n")
    found = stored(elsewhere.unionByName(own), "repeats")
    drop(pieces)
    return found, shards


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **sizes) -> DataFrame:
    """id, n_words, n_removed, kept (the words left, joined by single spaces) of each row.

    A word goes if a window of `window` consecutive words that covers it also starts earlier: in a row of smaller id,
    or earlier in the same text. Edge cases: a null text has no words; texts shorter than a window stay whole; rows
    that repeat id and text are one document and each get its result; different texts of one id are documents in the order of
    their hashes; rows without an id keep all their words and lend none; bytes that are not UTF-8 count as they are;
    a long text is one document like any other; columns of docs besides id and text play no part; an empty table gives none.
    """
    found, shards = repeated_windows(docs, id_col, text_col, window, **sizes)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("id", "ascending"), ("h", "ascending")])
        ids, hs, start, n = (right.column(c).to_numpy() for c in ("id", "h", "start", "n"))
        new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (hs[1:] != hs[:-1])))) if len(ids) else np.empty(0, np.int64)
        spans = {(int(ids[a]), int(hs[a])): (a, b) for a, b in zip(new.tolist(), [*new[1:].tolist(), len(ids)], strict=True)} if len(ids) else {}
        out: tuple[list, ...] = ([], [], [], [])
        for doc, h, text in zip(left.column("id").to_pylist(), left.column("h").to_pylist(), utf8(left.column("text")), strict=True):
            words = text.split()
            lo, hi = spans.get((doc, h), (0, 0))
            total = len(words)
            if hi > lo:
                change = np.zeros(total + 1, np.int64)
                np.add.at(change, start[lo:hi], 1)
                np.add.at(change, start[lo:hi] + n[lo:hi] + window - 1, -1)
                covered = np.cumsum(change[:-1]) > 0
                words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            for c, x in zip(out, (doc, total, total - len(words), b" ".join(words)), strict=True):
                c.append(x)
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["id", "n_words", "n_removed", "kept"])

    left = _keyed(docs, id_col, text_col).withColumn("shard", _shard(shards)).groupBy("shard")
    right = found.withColumn("shard", _shard(shards)).groupBy("shard")
    out = left.cogroup(right).applyInArrow(apply, "id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string")).withColumnRenamed("id", id_col)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _shard(shards: int):
    """Of a document by id and text, so that rows without an id are dealt out like all others."""
    return F.pmod(F.xxhash64("id", "h"), F.lit(shards)).cast("int")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(range(1, greatest(1, len(ws) - 18))) AS start,
         unnest(list_transform(range(1, greatest(1, len(ws) - 18)), lambda i: array_to_string(ws[i:i + 19], ' '))) AS t
  FROM d),
g AS (SELECT doc_id, start, row_number() OVER (PARTITION BY t ORDER BY doc_id, start) AS nth FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM g WHERE nth > 1),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM d),
k AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept
  FROM w ANTI JOIN c USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
