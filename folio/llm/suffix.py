"""Two-stage suffix sorting, to a bounded depth, and adjacent common prefixes.

Stage one sorts only the suffixes that are smaller than their successors, by their
first ``DEPTH`` bytes.  Stage two scans the first-byte buckets in ascending order and
places each larger suffix when the one after it comes up.  Suffixes that agree in
DEPTH bytes may stand in any order; shorter agreements are in true suffix order.
"""

from __future__ import annotations

import numpy as np

WORD_COUNT = 13
DEPTH = 8 * WORD_COUNT


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; zeros follow the end."""
    n = len(text)
    padded = np.zeros(-(-(n + DEPTH + 16) // 8) * 8 + 8, np.uint8)
    padded[:n] = text
    out = np.zeros(len(padded) - 8, np.uint64)
    for r in range(8):
        part = out[r::8]
        part[:] = padded[r : r + 8 * len(part)].view(">u8")
    return out


def _smaller_than_next(t: np.ndarray) -> np.ndarray:
    n = len(t)
    at = np.full(n, n - 1)
    differ = np.flatnonzero(t[:-1] != t[1:])
    at[differ] = differ
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.zeros(n, bool)
    inside = at < n - 1
    out[inside] = t[at[inside]] < t[at[inside] + 1]
    return out


def _direct(positions: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The positions in order of the DEPTH bytes from each."""
    order = np.argsort(w[positions], kind="stable")
    pos = positions[order]
    key = w[pos]
    new = np.ones(len(pos), bool)
    new[1:] = key[1:] != key[:-1]
    for k in range(1, WORD_COUNT):
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            break
        key = w[pos[tied] + 8 * k]
        differ = np.zeros(len(tied), bool)
        differ[1:] = (key[1:] != key[:-1]) & ~new[tied[1:]]
        if not differ.any():
            continue
        # Copies agree word after word; only groups whose members differ here are sorted.
        group = np.cumsum(new[tied]) - 1
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[differ]] = True
        rows = np.flatnonzero(mixed[group])
        at, key, mine = tied[rows], key[rows], group[rows]
        order = np.lexsort((key, mine))
        pos[at] = pos[at][order]
        key = key[order]
        new[at[1:]] |= (mine[1:] == mine[:-1]) & (key[1:] != key[:-1])
    return pos


def suffix_array(t: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    w = words_at(t) if w is None else w
    small = _smaller_than_next(t)
    direct = _direct(np.flatnonzero(small), w)
    first = t[direct]
    size = np.bincount(t, minlength=256)
    begin = np.cumsum(size) - size
    out = np.full(n, -1, np.int64)
    cut = np.searchsorted(first, np.arange(257))
    for c in np.flatnonzero(np.diff(cut)).tolist():
        end = begin[c] + size[c]
        out[end - (cut[c + 1] - cut[c]) : end] = direct[cut[c] : cut[c + 1]]
    fill = begin.copy()

    def induce(scanned: np.ndarray) -> None:
        """Put the larger suffixes right before the scanned ones at the fronts of their buckets."""
        before = scanned[scanned > 0] - 1
        before = before[~small[before]]
        if len(before):
            c = t[before].astype(np.int64)
            by = np.argsort(c, kind="stable")
            before, c = before[by], c[by]
            counts = np.bincount(c, minlength=256)
            rank = np.arange(len(c)) - (np.cumsum(counts) - counts)[c]
            out[fill[c] + rank] = before
            fill[:] += counts

    induce(np.array([n]))  # the empty suffix comes first
    for c in np.flatnonzero(size).tolist():
        at = begin[c]
        while at < fill[c]:  # entries of this bucket may add more to it
            end = fill[c]
            induce(out[at:end].copy())
            at = end
        induce(direct[cut[c] : cut[c + 1]])
    return out


def common_prefixes(sa: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it, at most DEPTH; 0 for the first."""
    out = np.zeros(len(sa), np.int64)
    live = np.arange(1, len(sa))
    for k in range(WORD_COUNT):
        x = w[sa[live] + 8 * k] ^ w[sa[live - 1] + 8 * k]
        same = x == 0
        other = live[~same]
        y = x[~same]
        lead = np.zeros(len(y), np.int64)
        for b in range(1, 8):
            lead += (y >> np.uint64(64 - 8 * b)) == 0
        out[other] = 8 * k + lead
        live = live[same]
    out[live] = DEPTH
    return out


def shared(sa: np.ndarray, w: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix has ``length`` bytes (8 to DEPTH) in common with the one before it; False for the first."""
    out = np.zeros(len(sa), bool)
    live = np.arange(1, len(sa))
    # The last word first: suffixes next to each other begin alike.
    for k in (length - 8, *range(0, length - 8, 8)):
        live = live[w[sa[live] + k] == w[sa[live - 1] + k]]
    out[live] = True
    return out
