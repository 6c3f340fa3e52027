"""Byte-level BPE by monoid tree reduction: halves are encoded apart and joined at their boundary."""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_text, table

LEAF_BYTES = 24
#: Pieces of text whose ids a worker remembers; as many again of those before them.
REMEMBERED = 200_000
DECODE_LEAF = 4096
#: Stands for the rank of two neighbours that make no token; over all ranks.
NO_RANK = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Pieces(dict):
    """The ids of the pieces seen of late; others are encoded when they are looked up."""

    def __init__(self, encode):
        self.encode, self.before = encode, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if (ids := self.before.get(piece)) is None:
            ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for a table of ranks and a pattern that parts a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pieces = ranks, regex.compile(pattern).findall
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known = _Pieces(self.piece)

    def merge(self, data: bytes) -> list[int]:
        """The ids of a short run of bytes: of all neighbours that make a token, the lowest rank (the leftmost) first."""
        ranks, n = self.ranks, len(data)
        if n < 64:
            parts = [data[i : i + 1] for i in range(n)]
            pairs = [ranks.get(data[i : i + 2], NO_RANK) for i in range(n - 1)]
            while pairs and (best := min(pairs)) < NO_RANK:
                i = pairs.index(best)
                whole = parts[i] + parts[i + 1]
                parts[i : i + 2] = [whole]
                del pairs[i]
                if i:
                    pairs[i - 1] = ranks.get(parts[i - 1] + whole, NO_RANK)
                if i < len(pairs):
                    pairs[i] = ranks.get(whole + parts[i + 1], NO_RANK)
            return [ranks[p] for p in parts]
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
                continue
            alive[mid], end[i] = False, stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether the tokens a, b, side by side, are what their bytes encode to.

        A sequence is the encoding of its bytes exactly if this holds for each pair of neighbours: a merge across the
        boundary of two tokens depends on these two tokens' bytes alone until one of them would be merged further.
        """
        key = (a, b)
        if (found := self.fits.get(key)) is None:
            if len(self.fits) > 4 * REMEMBERED:
                self.fits.clear()
            found = self.fits[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of both runs of bytes together: a window over the boundary is encoded anew, wider and wider on
        the side whose neighbour outside is not yet stable."""
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            middle = self.merge(b"".join(self.bytes_of[t] for t in left[-i:] + right[:j]))
            fine_left = i == len(left) or self.stable(left[-i - 1], middle[0])
            fine_right = j == len(right) or self.stable(middle[-1], right[j])
            if fine_left and fine_right:
                return left[:-i] + middle + right[j:]
            i = i if fine_left else min(2 * i, len(left))
            j = j if fine_right else min(2 * j, len(right))

    def reduce(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        rank = self.ranks.get(data)
        return tuple(self.reduce(data)) if rank is None else (rank,)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.pieces(text or ""))))

    def decode(self, ids: list[int]) -> bytes:
        """The tokens' bytes, concatenated up a tree over leaves of DECODE_LEAF tokens."""
        token = self.bytes_of.__getitem__
        runs = [b"".join(map(token, ids[i : i + DECODE_LEAF])) for i in range(0, len(ids), DECODE_LEAF)]
        while len(runs) > 1:
            runs = [b"".join(runs[i : i + 8]) for i in range(0, len(runs), 8)]
        return runs[0] if runs else b""


_codecs: dict[int, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """One codec a worker; the ranks come with a broadcast, about a megabyte for a vocabulary of 50,000."""
    if (key := hash((shared.id if hasattr(shared, "id") else id(shared), pattern))) not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value, pattern)
    return _codecs[key]


def _vocabulary(spark: SparkSession, ranks_path: str | None, pattern: str | None):
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return spark.sparkContext.broadcast(read_ranks(path)), pattern or public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id and ids (array of int) of each row.

    Edge cases: null texts count as empty and have no ids; bytes that are not UTF-8 are encoded as U+FFFD; a long piece is
    encoded by halves, whatever its length; rows that repeat an id, or have none, each get a row; other columns of docs
    play no part; an empty table gives none.
    """
    shared, pattern = _vocabulary(docs.sparkSession, ranks_path, pattern)

    def run(batches):
        codec = _codec(shared, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                yield pa.record_batch([part.column(0), pa.array([codec.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), clean_text(F.col(text_col)).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ranks_path: str | None = None) -> DataFrame:
    """id and text_bytes of each row of ids; null ids count as none."""
    shared, pattern = _vocabulary(encoded.sparkSession, ranks_path, None)

    def run(batches):
        codec = _codec(shared, pattern)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=["id", "text_bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, text_bytes binary").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, decoded again and digested where it is read.

    Edge cases as in encode_documents; without ids both digests are those of nothing.
    """
    shared, pattern = _vocabulary(docs.sparkSession, ranks_path, pattern)

    def run(batches):
        codec = _codec(shared, pattern)
        digits = {i: str(i) for i in codec.bytes_of}
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = codec.encode(t.as_py())
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), clean_text(F.col(text_col)).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
