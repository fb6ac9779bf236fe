"""Vectorised byte-level helpers shared by the Arrow-side operators.

Everything here works on one flat ``uint8`` buffer that holds the UTF-8 bytes of
many documents back to back, plus an offsets array.  No per-token Python loop is
needed to find words or to hash them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer document is handled whole.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Random odd multipliers; part of no file format, only of hashes inside a job.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
COMBINE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U64(2) + U64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        _pow = np.full(size, _BASE, np.uint64)
        _inv = np.full(size, _BASE_INV, np.uint64)
        _pow[0] = _inv[0] = 1
        np.multiply.accumulate(_pow, out=_pow)
        np.multiply.accumulate(_inv, out=_inv)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of T[buf[j]] * BASE**j over j < i; see :func:`span_hash`."""
    power, _ = _powers(len(buf) + 1)
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    terms = _BYTE[buf]
    terms *= power[: len(buf)]
    np.cumsum(terms, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal bytes give equal hashes."""
    _, inverse = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch, each of at most ``limit`` text bytes (or one row)."""
    buf, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(rows, max(end, at + 1))
        yield batch.slice(at, end - at), buf[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the row of each."""
    n = len(buf)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, row


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the word offsets of each row."""
    starts, ends, row = words(buf, offsets)
    h = span_hash(prefix_hash(LOWER[buf]), starts, ends)
    return h, np.searchsorted(row, np.arange(len(offsets)), side="left")


def ngrams(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside each row, and the index of each one's first item."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = h[: len(h) - n + 1] * COMBINE[0]
    for k in range(1, n):
        total = total + h[k : len(h) - n + 1 + k] * COMBINE[k]
    inside = np.ones(len(h) + 1, bool)
    for end in range(1, n):
        at = offsets[1:] - end
        inside[at[at >= 0]] = False
    first = np.flatnonzero(inside[: len(total)])
    return mix(total[first] + U64(n)), first
