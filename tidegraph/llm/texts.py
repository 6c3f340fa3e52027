"""Words of many texts at once, as arrays: places, documents and 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The bytes of a column of strings, whether they are valid UTF-8 or not; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts: start and end in `data`, the text each belongs to, and its hash.

    With stem_bytes, also the hash of each word's first so many bytes.
    """

    def __init__(self, texts: list[bytes], stem_bytes: int = 0):
        self.data = data = b"\n".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_at = np.concatenate(([0], np.cumsum(sizes + 1)))
        bytes_ = np.frombuffer(data, np.uint8)
        solid = np.concatenate(([False], ~_BLANK[bytes_], [False]))
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        self.text = np.searchsorted(self.text_at, self.start, "right") - 1
        self.last = np.searchsorted(self.start, self.text_at[1:])  # one past the last word of each text
        up, down = _power_tables(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((bytes_.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
        self.hash = mixed((sums[self.end] - sums[self.start]) * down[self.start])
        if stem_bytes:
            self.stem = mixed((sums[np.minimum(self.end, self.start + stem_bytes)] - sums[self.start]) * down[self.start])

    def __len__(self) -> int:
        return len(self.start)


def slices(texts: list[bytes], most: int = 1 << 20):
    """Ranges of texts of at most `most` bytes each, or of one longer text."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)
