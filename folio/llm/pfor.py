"""Patched frame-of-reference coding of token ids.

A segment holds ``n`` ids in blocks of 128.  Each block stores its minimum, the
differences to it packed at a width that most of them fit (a percentile of the
block), and the bits beyond that width of the others in an exception list.

Segment layout, little endian: ``b"PFR1"``, u32 n, u32 blocks, u32 words,
u32 exceptions, then u32 word starts per block (the index), u32 minima, u8 widths,
u8 exception counts, u64 packed words, u8 exception places, u32 exception bits.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 128
MAGIC = b"PFR1"


def _widths(delta: np.ndarray, percentile: float) -> np.ndarray:
    k = min(BLOCK - 1, int(percentile * (BLOCK - 1)))
    top = np.partition(delta, k, axis=1)[:, k]
    return np.where(top > 0, np.frexp(top.astype(np.float64))[1], 0).astype(np.uint8)


def encode(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """One segment.  No ids give a segment without blocks."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.zeros(blocks * BLOCK, np.int64)
    v[:n] = ids
    if n:
        v[n:] = v[n - 1]
    v = v.reshape(blocks, BLOCK)
    low = v.min(axis=1) if blocks else np.zeros(0, np.int64)
    delta = v - low[:, None]
    width = _widths(delta, percentile) if blocks else np.zeros(0, np.uint8)
    high = delta >> width[:, None]
    row, place = np.nonzero(high)
    counts = np.bincount(row, minlength=blocks).astype(np.uint8)
    starts = np.zeros(blocks + 1, np.int64)
    np.cumsum(2 * width.astype(np.int64), out=starts[1:])
    packed = np.zeros(starts[-1], np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        which = np.flatnonzero(width == w)
        cols = np.ascontiguousarray((delta[which] & ((1 << w) - 1)).T).astype(np.uint64)
        words = np.zeros((2 * w, len(which)), np.uint64)
        for c in range(BLOCK):
            word, shift = divmod(c * w, 64)
            words[word] |= cols[c] << np.uint64(shift)
            if shift + w > 64:
                words[word + 1] |= cols[c] >> np.uint64(64 - shift)
        packed[starts[which][:, None] + np.arange(2 * w)] = words.T
    head = MAGIC + struct.pack("<4I", n, blocks, len(packed), len(row))
    parts = (starts[:-1].astype("<u4"), low.astype("<u4"), width, counts, packed.astype("<u8"), place.astype(np.uint8), high[row, place].astype("<u4"))
    return head + b"".join(p.tobytes() for p in parts)


class Segment:
    """A parsed segment; blocks are decoded on demand."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.n, self.blocks, words, exceptions = struct.unpack_from("<4I", data, 4)
        at = 20

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.starts, self.low = take("<u4", self.blocks), take("<u4", self.blocks)
        self.width, self.counts = take("u1", self.blocks), take("u1", self.blocks)
        self.words = take("<u8", words)
        self.places, self.bits = take("u1", exceptions), take("<u4", exceptions)
        self.first = np.zeros(self.blocks + 1, np.int64)
        np.cumsum(self.counts, out=self.first[1:])

    def decode(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids [begin, end) as uint32; only the blocks that hold them are unpacked."""
        end = self.n if end is None else min(end, self.n)
        if begin >= end:
            return np.zeros(0, np.uint32)
        b0, b1 = begin // BLOCK, -(-end // BLOCK)
        out = np.zeros((b1 - b0, BLOCK), np.uint32)
        width = self.width[b0:b1]
        for w in np.unique(width[width > 0]).tolist():
            which = np.flatnonzero(width == w)
            words = np.ascontiguousarray(self.words[self.starts[b0 + which].astype(np.int64)[:, None] + np.arange(2 * w)].T)
            got = np.empty((BLOCK, len(which)), np.uint32)
            mask = np.uint64((1 << w) - 1)
            for c in range(BLOCK):
                word, shift = divmod(c * w, 64)
                x = words[word] >> np.uint64(shift)
                if shift + w > 64:
                    x = x | (words[word + 1] << np.uint64(64 - shift))
                got[c] = x & mask
            out[which] = got.T
        e0, e1 = self.first[b0], self.first[b1]
        row = np.repeat(np.arange(b1 - b0), self.counts[b0:b1])
        np.bitwise_or.at(out, (row, self.places[e0:e1].astype(np.int64)), self.bits[e0:e1] << width[row].astype(np.uint32))
        out += self.low[b0:b1, None]
        return out.reshape(-1)[begin - b0 * BLOCK : end - b0 * BLOCK]
