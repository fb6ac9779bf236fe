"""Longest common subsequences of lines, 64 cells a step.

A row of the table of common lengths is one integer: bit k says whether its value stays
the same when the k-th line from the end is put before the others, and the next row takes an
addition.  For a script, every ``sqrt(rows)``-th row is kept, and the rows between are made again while
the script is read off, so memory grows with the lines, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Line numbers of masks that are kept, at most, as a multiple of the lines.
_MASKS = 4


class _Rows:
    """Rows of the table for a fixed second text, from its end."""

    def __init__(self, b: list[str]):
        self.size = len(b)
        self.full = (1 << self.size) - 1
        self.places: dict[str, list[int]] = {}
        for k, line in enumerate(reversed(b)):
            self.places.setdefault(line, []).append(k)
        self.masks: dict[str, int] = {}

    def _mask(self, line: str) -> int:
        if line not in self.places:
            return 0
        mask = self.masks.get(line)
        if mask is None:
            raw = bytearray(self.size // 8 + 1)
            for k in self.places[line]:
                raw[k >> 3] |= 1 << (k & 7)
            mask = int.from_bytes(raw, "little")
            if len(self.masks) * self.size < 8 * _MASKS * (1 << 20):  # 4 MB of masks
                self.masks[line] = mask
        return mask

    def step(self, row: int, line: str) -> int:
        """The row with ``line`` put before the first text."""
        both = row & self._mask(line)
        return ((row + both) | (row - both)) & self.full if both else row

    def over(self, lines: Iterator[str]) -> int:
        row = self.full
        for line in lines:
            row = self.step(row, line)
        return row


def _head(a: list[str], b: list[str]) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    a, b = list(a), list(b)
    head = _head(a, b)
    a, b = a[head:], b[head:]
    rows = _Rows(b)
    return head + rows.size - rows.over(reversed(a)).bit_count()


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Lines kept (=), added (+) and removed (-) on a longest common subsequence; of equal choices an addition goes first."""
    head = _head(a, b)
    out, a, b = [("=", x) for x in a[:head]], a[head:], b[head:]
    rows = _Rows(b)
    gap = max(1, int(len(a) ** 0.5))
    marks, row = {len(a): rows.full}, rows.full
    for i in range(len(a) - 1, -1, -1):
        row = rows.step(row, a[i])
        if i % gap == 0:
            marks[i] = row
    i = j = 0
    below: dict[int, int] = {}
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(("=", a[i]))
            i, j = i + 1, j + 1
            continue
        if i not in below:
            low = min(len(a), (i // gap + 1) * gap)
            row, below = marks[low], {}
            for k in range(low - 1, i - 1, -1):
                row = rows.step(row, a[k])
                below[k] = row
        if below[i] >> (len(b) - 1 - j) & 1:
            out.append(("+", b[j]))
            j += 1
        else:
            out.append(("-", a[i]))
            i += 1
    return out + [("-", x) for x in a[i:]] + [("+", x) for x in b[j:]]
