"""The edit distance of a snippet to the nearest line of a text, for many snippets at once.

A column of the table of distances is a pair of bit vectors (where it rises, where it falls),
so 64 cells are one step (Myers 1999, in blocks), and every step is one NumPy operation over
all pairs of snippet and line.  The line of the nearest length is measured first; of the others
only those whose length may be nearer, and each of them only while it still may.
"""

from __future__ import annotations

import numpy as np

#: Snippets measured together.
GROUP = 1024
#: The white space that is trimmed from lines.
EDGE = "\t\n\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ONE, _TOP = np.uint64(1), np.uint64(63)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _measure(masks: np.ndarray, size: np.ndarray, ref: np.ndarray, chars: np.ndarray, start: np.ndarray, length: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Distances of snippets ``ref`` to texts (start, length) of ``chars``; ``bound`` where they are not below it."""
    out = bound.copy()
    blocks, live = masks.shape[2], np.arange(len(ref))
    up = np.full((blocks, len(ref)), ~np.uint64(0))
    down = np.zeros((blocks, len(ref)), np.uint64)
    score = size[ref].astype(np.int64)
    last, bit = (size[ref] - 1) // 64, ((size[ref] - 1) % 64).astype(np.uint64)
    for j in range(int(length.max(initial=0))):
        eq = masks[ref, chars[start + j]]
        plus, minus = np.full(len(ref), _ONE), np.zeros(len(ref), np.uint64)
        for k in range(blocks):
            here, p, m = eq[:, k], up[k], down[k]
            x = here | m
            here = here | minus
            h = (((here & p) + p) ^ p) | here
            rise, fall = m | ~(h | p), p & h
            end = last == k
            score += np.where(end, (rise >> bit & _ONE).astype(np.int64) - (fall >> bit & _ONE).astype(np.int64), 0)
            into_plus, into_minus = plus, minus
            plus, minus = rise >> _TOP, fall >> _TOP
            rise, fall = rise << _ONE | into_plus, fall << _ONE | into_minus
            up[k], down[k] = fall | ~(x | rise), rise & x
        done = length == j + 1
        if done.any():
            out[live[done]] = np.minimum(out[live[done]], score[done])
        # Each further character takes at most one off.
        stay = ~done & (score - (length - j - 1) < bound)
        if not stay.all():
            live, ref, start, length, bound, score, last, bit = (a[stay] for a in (live, ref, start, length, bound, score, last, bit))
            up, down = up[:, stay], down[:, stay]
            if not len(live):
                break
    return out


def _nearest(snippets: list[str], pages: list[list[str]]) -> list[int]:
    """For each snippet (not empty) the least distance to a line, its own length at most."""
    size = np.array([len(s) for s in snippets], np.int64)
    lines = [x for page in pages for x in page]
    owner = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    start = np.cumsum(length) - length
    gap = np.abs(length - size[owner])
    worth = np.flatnonzero(gap < size[owner])
    best = size.copy()
    if not len(worth):
        return best.tolist()
    letters, coded = np.unique(_codes("".join(snippets)), return_inverse=True)
    text = _codes("".join(lines))
    at = np.minimum(np.searchsorted(letters, text), len(letters) - 1)
    chars = np.where(letters[at] == text, at, len(letters))
    masks = np.zeros((len(snippets), len(letters) + 1, int(-(-size.max() // 64))), np.uint64)
    row, col = np.repeat(np.arange(len(snippets)), size), np.arange(len(coded)) - np.repeat(np.cumsum(size) - size, size)
    np.bitwise_or.at(masks, (row, coded, col // 64), _ONE << (col % 64).astype(np.uint64))
    worth = worth[np.lexsort((gap[worth], owner[worth]))]
    first = np.ones(len(worth), bool)
    first[1:] = owner[worth[1:]] != owner[worth[:-1]]
    for wave in (worth[first], worth[~first]):
        wave = wave[gap[wave] < best[owner[wave]]]
        if len(wave):
            got = _measure(masks, size, owner[wave], chars, start[wave], length[wave], best[owner[wave]])
            np.minimum.at(best, owner[wave], got)
    return best.tolist()


def snippet_errors(snippets: list[list[str | None] | None], pages: list[str | None]) -> list[list[float | None] | None]:
    """Errors of the snippets of each page: 0 if it holds the snippet, else the least distance to a line over the snippet's length, 1 at most."""
    out: list[list[float | None] | None] = []
    todo: list[tuple[int, int, str, list[str]]] = []
    for i, (asked, page) in enumerate(zip(snippets, pages, strict=True)):
        if asked is None or page is None:
            out.append(None if asked is None else [None] * len(asked))
            continue
        lines = None
        errors: list[float | None] = []
        for k, s in enumerate(asked):
            if s is None or s == "" or page == "" or s in page:
                errors.append(None if s is None else 1.0 if s and page == "" else 0.0)
                continue
            if lines is None:
                lines = [x for x in (line.strip(EDGE) for line in page.split("\n")) if x]
            errors.append(1.0)
            todo.append((i, k, s, lines))
        out.append(errors)
    # Snippets of like length go together, so that a long one does not widen all.
    todo.sort(key=lambda x: len(x[2]))
    for a in range(0, len(todo), GROUP):
        part = todo[a : a + GROUP]
        for (i, k, s, _), d in zip(part, _nearest([x[2] for x in part], [x[3] for x in part]), strict=True):
            out[i][k] = min(1.0, d / len(s))
    return out
