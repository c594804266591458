"""NumPy helpers over the UTF-8 bytes of many texts at once (inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Texts are taken together up to so many bytes; a longer text is taken alone.
CHUNK = 2 << 20
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)


def separators(spans: list[tuple[int, int]]) -> np.ndarray:
    """Table over bytes: True where a byte separates words."""
    table = np.zeros(256, bool)
    for first, last in spans:
        table[first : last + 1] = True
    return table


#: Words are [^\x20\x09-\x0D]+
BLANKS = separators([(0x20, 0x20), (0x09, 0x0D)])
#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing
NOT_ALNUM = separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch whose texts have at most `limit` bytes together (a longer text comes alone), with bytes and offsets."""
    data, at = utf8(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each text's first word (one more entry than texts). No word spans two texts."""
    n = len(data)
    inside = ~table[data]
    cut = at[(at > 0) & (at < n)]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[cut] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[cut - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, at)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@cache
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        _powers[:] = []
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any span follows."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_codes()[data] * powers(len(data) + 1)[0][: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal spans have equal hashes."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def gram_hashes(h: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m entries from each position on (m - 1 fewer positions)."""
    n = len(h) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(m):
        out = out * _BASE + h[j : j + n]
    return mix(out)


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each span, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.repeat(start - first, length) + np.arange(total)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
