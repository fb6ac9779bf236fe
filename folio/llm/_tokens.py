"""Exact tokenizer output through a cache of pre-token pieces.

A text is cut at places where the tokenizer provably never joins two sides, the
pieces are hashed with numpy, and only pieces that this worker has not met yet
go through the library.  The cuts depend on the tokenizer's family:

``byte``   byte-level BPE with the usual contraction/letter/number pattern: white
           space belongs to what follows it, so cut before each ASCII white-space
           run that follows a character which is surely no white space;
``word``   white space is dropped: pieces are the words between ASCII white space;
           Both also cut between an ASCII letter and one of ``, . ; : ! ? " ( )``;
``piece``  a sentencepiece BPE model in which no piece holds a space after its
           first character and none holds a newline: cut before each space that
           follows a non-space and before each newline.
"""

from __future__ import annotations

import os

import numpy as np

from folio.llm import _bytes as B

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces a worker keeps before it starts anew; about 40 bytes each.
CACHE_PIECES = 1_500_000
#: Token ids a worker keeps before it starts anew, besides those of the stretch at hand: text without white space makes long pieces.
CACHE_IDS = 1 << 24
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b',.;:!?"()')] = True
_FIRST = np.uint64(0xA24BAED4963EE407)


def _maybe_space(buf: np.ndarray, at: np.ndarray, mark: bool) -> np.ndarray:
    """Whether the character that ends right before each position may be white space."""
    one = buf[at - 1]
    unsure = B.SPACE[one] | ((one >= 0x1C) & (one <= 0x1F))
    odd = np.flatnonzero(one >= 0x80)
    if len(odd):
        p = at[odd]
        one, two = buf[p - 1], buf[np.maximum(p - 2, 0)]
        three = buf[np.maximum(p - 3, 0)]
        nbsp = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
        wide = ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
        unsure[odd] = nbsp | wide | (mark & (three == 0xE2) & (two == 0x96) & (one == 0x81))
    return unsure


def cut(buf: np.ndarray, offsets: np.ndarray, family: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and hashes of the pieces of each text."""
    prefix = B.prefix_hash(buf)
    n = len(buf)
    stop = np.flatnonzero(_STOP[buf[1:]] & _LETTER[buf[:-1]]) + 1
    if family == "word":
        starts, ends, _ = B.words(buf, offsets)
        inner = stop[~np.isin(stop, offsets)] if len(offsets) > 2 else stop
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        row = np.searchsorted(offsets, starts, side="right") - 1
        return starts, ends, row, B.span_hash(prefix, starts, ends)
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    start = np.zeros(n, bool)
    if family == "byte":
        at = np.flatnonzero(B.SPACE[buf])
        at = at[at > 0]
        start[at[~_maybe_space(buf, at, False)]] = True
        start[stop] = True
    else:
        at = np.flatnonzero(buf == 0x20)
        at = at[at > 0]
        one = buf[at - 1]
        ok = one != 0x20
        odd = np.flatnonzero(one >= 0x80)
        ok[odd] = ~_maybe_space(buf, at[odd], True)
        start[at[ok]] = True
        start[buf == 0x0A] = True
    start[filled] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n) if len(starts) else starts
    row = np.searchsorted(offsets, starts, side="right") - 1
    h = B.span_hash(prefix, starts, ends)
    if family == "piece":  # a text's first piece gets a leading mark of its own
        first = np.searchsorted(starts, filled)
        h[first] ^= _FIRST
    return starts, ends, row, h


class Library:
    """A tokenizer of one of the three families; ids of single pieces."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            self.family = "piece"
            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.family = "byte" if self.model.normalizer is None else "word"
        size = self.model.get_piece_size() if self.family == "piece" else max(self.model.get_vocab(with_added_tokens=True).values(), default=0) + 1
        #: The narrowest type that holds every id.
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32

    def encode(self, pieces: list[bytes], first: list[bool] | None = None) -> list[list[int]]:
        if self.family != "piece":
            return self._encode_plain([p.decode("utf-8", "replace") for p in pieces])
        # A leading space of a later piece is the model's own mark; before a newline the mark stands alone and is taken off.
        own = [p[1:] if not f and p[:1] == b" " else p for p, f in zip(pieces, first, strict=True)]
        ids = self.model.encode([p.decode("utf-8", "replace") for p in own], num_threads=1)
        alone = [self.model.piece_to_id("\u2581")]
        return [x if f else x[1:] if p[:1] == b"\n" else alone if p == b" " else x for x, p, f in zip(ids, pieces, first, strict=True)]


    def _encode_plain(self, pieces: list[str]) -> list[list[int]]:
        """A piece of ASCII letters is one pre-token, so the model may take it at once; the rest pass the whole library."""
        mark, lower, model = ("\u0120", False, self.model.model) if self.family == "byte" else ("", True, self.model.model)
        out: list[list[int]] = [[]] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            w = p[1:] if mark and p[:1] == " " else p
            if w.isascii() and w.isalpha():
                out[i] = [t.id for t in model.tokenize(w.lower() if lower else mark + w if w is not p else w)]
            else:
                rest.append(i)
        for i, e in zip(rest, self.model.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


class PieceCache:
    """Piece hash -> token ids (or, with ``ids=False``, only their number)."""

    def __init__(self, path: str, ids: bool = True):
        self.lib, self.ids = Library(path), ids
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.flat = np.zeros(0, self.lib.dtype)
        self.used = 0

    def _learn(self, fresh: np.ndarray, pieces: list[bytes], first: list[bool]) -> None:
        got = self.lib.encode(pieces, first)
        length = np.fromiter(map(len, got), np.int32, len(got))
        at = np.zeros(len(got), np.int64)
        if self.ids:
            flat = np.fromiter((i for x in got for i in x), self.lib.dtype, int(length.sum()))
            at = self.used + np.cumsum(length) - length
            if self.used + len(flat) > len(self.flat):
                grown = np.zeros(max(2 * len(self.flat), self.used + len(flat), 1 << 16), self.lib.dtype)
                grown[: self.used] = self.flat[: self.used]
                self.flat = grown
            self.flat[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
        where = np.searchsorted(self.known, fresh)
        self.known = np.insert(self.known, where, fresh)
        self.at = np.insert(self.at, where, at)
        self.length = np.insert(self.length, where, length)

    def _slots(self, buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Cache slots of the pieces; those not met before are encoded first."""
        if len(self.known) > CACHE_PIECES or self.used > CACHE_IDS:
            self.clear()
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.known, uniq)
        hit = slot < len(self.known)
        hit[hit] = self.known[slot[hit]] == uniq[hit]
        if not hit.all():
            miss = first[~hit]
            raw, texts = buf.tobytes(), set(offsets[:-1].tolist())
            where = list(zip(starts[miss].tolist(), ends[miss].tolist(), strict=True))
            self._learn(uniq[~hit], [raw[s:e] for s, e in where], [s in texts for s, _ in where])
            slot = np.searchsorted(self.known, uniq)
        return slot[inverse]

    def count(self, buf: np.ndarray, offsets: np.ndarray, known: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Token counts of the texts: a table of frequent pieces first, this cache for the rest."""
        starts, ends, row, h = cut(buf, offsets, self.lib.family)
        n = np.zeros(len(h), np.int64)
        hit = np.zeros(len(h), bool)
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            n[hit] = length[at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            slot = self._slots(buf, offsets, starts[miss], ends[miss], h[miss])
            n[miss] = self.length[slot]
        return np.bincount(row, weights=n, minlength=len(offsets) - 1).astype(np.int64)

    def lookup(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, token count and cache slot of every piece of the texts."""
        starts, ends, row, h = cut(buf, offsets, self.lib.family)
        slot = self._slots(buf, offsets, starts, ends, h)
        return row, self.length[slot].astype(np.int64), slot

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts back to back, ``end_id`` after each, and their offsets."""
        row, length, slot = self.lookup(buf, offsets)
        rows = len(offsets) - 1
        per_row = np.bincount(row, weights=length, minlength=rows).astype(np.int64)
        extra = 0 if end_id is None else 1
        out_off = np.zeros(rows + 1, np.int64)
        np.cumsum(per_row + extra, out=out_off[1:])
        out = np.empty(out_off[-1], self.lib.dtype if extra == 0 or end_id <= np.iinfo(self.lib.dtype).max else np.uint32)
        total = int(length.sum())
        if total:
            begin = np.cumsum(length) - length
            source = np.repeat(self.at[slot] - begin, length) + np.arange(total)
            place = np.arange(total) + (np.repeat(row, length) if extra else 0)
            out[place] = self.flat[source]
        if extra:
            out[out_off[1:] - 1] = end_id
        return out, out_off


_caches: dict[tuple[str, bool], PieceCache] = {}


def worker_cache(path: str, ids: bool = True) -> PieceCache:
    """The cache of this worker process; tasks that follow each other share it."""
    if (path, ids) not in _caches:
        _caches[path, ids] = PieceCache(path, ids)
    return _caches[path, ids]
