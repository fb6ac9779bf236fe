"""Language-model scores from a log-frequency Bloom filter.

Training sums the counts of tokens and of n-grams up to ``ORDER`` over a stretch of text
before anything shuffles; a shard (a range of hashes) then adds them up.  A shard keeps exact
token counts, and a Bloom filter in which an n-gram of count c is entered once for each level
1 .. 1 + floor(log_BASE(c)); every n-gram counts, those seen once too.  A probe asks
for level 1, 2, ... until one is missing; the last one found gives the count, rounded
down to a power of BASE.

Scores: P(w) = (c(w) + 1) / (N + V + 1).  With h the one token, then the two tokens,
before w (a text begins with START), P(w | h) = (c(h w) + T P') / (c(h) + T), where P'
is the probability by the next shorter h and T = c(h)**TYPES, the expected number of
different continuations.  A context that was never seen leaves P' as it is.

Where the model is: it stays in its shards, and nothing of it passes through the driver.
Each stretch of text, whatever its fold, sends its distinct hashes once to the shards that
own them, with their counts in the training fold (0 where they occur only outside).  A shard
learns from the counts and then answers all the hashes from its filter, so what is sent to
learn is also what is asked, and work and traffic are proportional to the text at any size.
With ``max_broadcast`` (bytes) a model that is no larger is broadcast instead, for many
texts against a small model; it passes through the driver.  Both ways give the same scores.

Defined cases: a null text is empty (its end token alone); a null ``doc_id`` belongs
to the training fold; repeated rows count once each; without training text every
token has P = 1 / 1, score 0; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm import _bytes as B
from folio.session import keep, ship

END, START = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
#: Longest n-gram; levels grow by BASE; exponent of T.
ORDER, BASE, TYPES = 3, 1.5, 0.75
#: Filter bits for an entry, and how many of a 64-bit word an entry sets.
ENTRY_BITS, PROBES = 12, 3
#: Bytes of one broadcast.
BROADCAST_PART = 48 << 20
TRAIN_CHUNK = 4 << 20
#: Counts in a stretch from which a hash is held back to the end of the task, and the hashes held back at most.
FREQUENT, HELD = 8, 1 << 19
#: Text bytes of a shard, from 2048 shards on, and of a chunk whose hashes go to the shards: each chunk sends rows to every shard, so few of both keep their product small.
_SHARD_BYTES, _ASK_CHUNK = 32 << 20, 8 << 20
#: Probes that a shard answers at once.
_ANSWERS = 1 << 20
#: Above the level of any 64-bit count.
_MAX_LEVEL = 110
#: n-gram hashes keep the bits that name a shard and 40 more.
_KEY_BITS = 40
_MAGIC = b"folio-lm-model-1"


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def sequences(buf: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Token hashes with an end after each text, their offsets, and for n = 2 .. order the hash of the n-gram that ends at each token.

    The first token of a text follows START; an n-gram that would begin before START is 0.
    """
    h, at = B.word_hashes(buf, offsets)
    rows = len(at) - 1
    off = at + np.arange(rows + 1)
    tokens = np.empty(off[-1], np.uint64)
    tokens[off[1:] - 1] = END
    inner = np.ones(len(tokens), bool)
    inner[off[1:] - 1] = False
    tokens[inner] = h
    place = np.arange(len(tokens)) - np.repeat(off[:-1], np.diff(off))
    grams, last = [], tokens
    for n in range(2, order + 1):
        before = np.empty_like(tokens)
        before[1:] = last[:-1]
        before[off[:-1]] = START
        last = B.mix(before * B.COMBINE[0] + tokens * B.COMBINE[1] + np.uint64(n))
        last[place < n - 2] = 0
        grams.append(last)
    return tokens, off, grams


def _cut_hash(grams: np.ndarray, bits: int) -> np.ndarray:
    low = np.uint64(max(0, 64 - bits - _KEY_BITS))
    return grams >> low << low


def _distinct(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of n-grams, ascending (0 is none of them), and their counts."""
    keys, n = np.unique(_cut_hash(grams, bits), return_counts=True)
    return (keys[1:], n[1:]) if len(keys) and keys[0] == 0 else (keys, n)


def _high(lengths: np.ndarray) -> np.ndarray:
    """Which bytes of packed lists are the fifth ones of their keys: they stand first in each list."""
    mask = np.zeros(5 * int(lengths.sum()), bool)
    mask[np.arange(len(mask) // 5) + np.repeat(4 * (np.cumsum(lengths) - lengths), lengths)] = True
    return mask


def _pack_keys(keys: np.ndarray, bits: int, cut: list[int] | None = None) -> bytes:
    """The bits of n-gram hashes below those that name the shard, as differences within each list (``cut``: where the lists begin, and the last ends), five bytes each.

    Few differences of a list of a thousand need the fifth byte, so those bytes, side by side, shrink to little when they shuffle.
    """
    low, lists = np.uint64(max(0, 64 - bits - _KEY_BITS)), np.array([0, len(keys)] if cut is None else cut, np.int64)
    v = keys << np.uint64(bits) >> np.uint64(bits) >> low
    step = v.copy()
    step[1:] -= v[:-1]
    first = lists[:-1][np.diff(lists) > 0]
    step[first] = v[first]
    octets = step.astype("<u8").view(np.uint8).reshape(-1, 8)
    out, high = np.empty(5 * len(keys), np.uint8), _high(np.diff(lists))
    out[high], out[~high] = octets[:, 4], octets[:, :4].reshape(-1)
    return out.tobytes()


def _unpack_keys(raw: list[bytes], shard: int, bits: int) -> np.ndarray:
    """The hashes of packed lists of one shard, back to back."""
    low, lengths = np.uint64(max(0, 64 - bits - _KEY_BITS)), np.array([len(x) // 5 for x in raw], np.int64)
    buf, high = np.frombuffer(b"".join(raw), np.uint8), _high(lengths)
    total = np.cumsum(buf[high].astype(np.uint64) << np.uint64(32) | buf[~high].view("<u4"), dtype=np.uint64)
    before = np.append(np.uint64(0), total)[np.cumsum(lengths) - lengths]
    v = (total - np.repeat(before, lengths)) & np.uint64((1 << _KEY_BITS) - 1)
    return (v << low) | np.uint64(shard << (64 - bits))


def _places(grams: np.ndarray, level: int, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit mask of the entry (gram, level); ``size`` words belong to its shard, from ``first``."""
    h = B.mix(grams + np.uint64(level * int(B.COMBINE[2]) % 2**64))
    word = first + ((h >> np.uint64(32)) * size >> np.uint64(32))
    mask = np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        mask |= np.uint64(1) << (h >> np.uint64(6 * k) & np.uint64(63))
    return word.astype(np.int64), mask


def levels_of(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9)).astype(np.int64)


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Model(NamedTuple):
    """The shards from ``low`` to ``high`` (exclusive) of a model."""

    low: int
    high: int
    bits: int
    known: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    size: np.ndarray
    words: np.ndarray

    def _own(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        own = np.flatnonzero((shard >= self.low) & (shard < self.high))
        return own, shard[own] - self.low

    def count_of(self, tokens: np.ndarray, out: np.ndarray) -> None:
        """Fill in the exact counts of the token hashes that belong here."""
        own, _ = self._own(tokens)
        if len(own) and len(self.known):
            uniq, inverse = np.unique(tokens[own], return_inverse=True)
            at = np.minimum(np.searchsorted(self.known, uniq), len(self.known) - 1)
            out[own] = np.where(self.known[at] == uniq, self.counts[at], 0).astype(np.int64)[inverse]

    def level_of(self, grams: np.ndarray, out: np.ndarray) -> None:
        """Fill in the levels of the n-gram hashes that belong here, by repeated probes; 0 where even level 1 is missing."""
        live, s = self._own(grams)
        ok = (grams[live] != 0) & (self.size[s] > 0)
        live, s = live[ok], s[ok]
        for k in range(1, _MAX_LEVEL + 1):
            if not len(live):
                break
            word, mask = _places(grams[live], k, self.first[s], self.size[s])
            ok = self.words[word] & mask == mask
            live, s = live[ok], s[ok]
            out[live] = k


def look_up(parts: list[Model], tokens: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Counts of tokens and levels of n-grams."""
    c, levels = np.zeros(len(tokens), np.int64), [np.zeros(len(g), np.uint8) for g in grams]
    grams = [_cut_hash(g, parts[0].bits) for g in grams]
    for m in parts:
        m.count_of(tokens, c)
        for g, out in zip(grams, levels, strict=True):
            m.level_of(g, out)
    return c, levels


def _by_shard(keys: np.ndarray, bits: int) -> tuple[np.ndarray, list[int]]:
    """The shards of ascending hashes, and where the hashes of each begin (and the last end)."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    return shard[first], [*first.tolist(), len(keys)]


def _parts(raw: bytes, cut: list[int], width: int) -> pa.Array:
    return pa.array([raw[width * a : width * b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary())


def _counts(n: np.ndarray, cut: list[int]) -> pa.Array:
    """Counts of each list, u16 at most: low bytes, high bytes, and few values among them, so they are compressed."""
    low = np.minimum(n, 65535).astype("<u2").view(np.uint8).reshape(-1, 2)
    return pa.array([pa.compress(low[a:b].T.tobytes(), codec="zstd", asbytes=True) for a, b in zip(cut, cut[1:], strict=False)], pa.binary())


def _counts_of(packed: list[bytes], lengths: list[int]) -> np.ndarray:
    lists = (np.frombuffer(pa.decompress(x, decompressed_size=2 * size, codec="zstd", asbytes=True), np.uint8) for x, size in zip(packed, lengths, strict=True))
    return np.concatenate([np.zeros(0, np.int64), *(x[: len(x) // 2] + 256 * x[len(x) // 2 :].astype(np.int64) for x in lists)])


def _learn(table: pa.Table, bits: int, entry_bits: int) -> Model:
    """The shard that rows of hashes and their counts make; hashes of count 0 leave nothing in it."""
    shard, kind = table.column("shard")[0].as_py(), table.column("kind").to_numpy()
    keys, n = table.column("keys").to_pylist(), table.column("n").to_pylist()

    def add(mine: np.ndarray, width: int, unpack: Callable[[list[bytes]], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(mine).tolist()
        counts = _counts_of([n[i] for i in rows], [len(keys[i]) // width for i in rows])
        return _add_up(unpack([keys[i] for i in rows])[counts > 0], counts[counts > 0])

    known, counts = add(kind == 1, 8, lambda raw: np.frombuffer(b"".join(raw), np.uint64))
    grams, times = add(kind > 1, 5, lambda raw: _unpack_keys(raw, shard, bits))
    level = levels_of(times)
    words = np.zeros(-(-int(level.sum()) * entry_bits // 64), np.uint64)
    size = np.full(len(grams), len(words), np.uint64)
    for k in range(1, int(level.max(initial=0)) + 1):
        deep = level >= k
        word, mask = _places(grams[deep], k, np.uint64(0), size[deep])
        np.bitwise_or.at(words, word, mask)
    return Model(shard, shard + 1, bits, known, counts, np.zeros(1, np.uint64), np.array([len(words)], np.uint64), words)


def train(docs: DataFrame, text: str = "text", entry_bits: int = ENTRY_BITS, order: int = ORDER) -> tuple[DataFrame, int]:
    """The model, one row per shard, written to the shared folder; and the number of hash bits that name a shard."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = shard_bits(size)

    def send(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        while len(keys):  # counts are sent as u16; more in further rows
            shard, cut = _by_shard(keys, bits)
            packed = _parts(keys.tobytes(), cut, 8) if kind == 1 else _parts(_pack_keys(keys, bits, cut), cut, 5)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array([min(kind, 2)] * len(shard), pa.int32()), packed, _counts(n, cut)], ["shard", "kind", "keys", "n"])
            more = n > 65535
            keys, n = keys[more], n[more] - 65535

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {kind: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for kind in range(1, order + 1)}
        for batch in batches:
            for _, buf, offsets in B.chunks(batch, "text", TRAIN_CHUNK):
                tokens, _, grams = sequences(buf, offsets, order)
                for kind, hashes in enumerate((tokens, *grams), 1):
                    keys, n = np.unique(hashes, return_counts=True) if kind == 1 else _distinct(hashes, bits)
                    often = n >= FREQUENT
                    yield from send(kind, keys[~often], n[~often])
                    held[kind] = _add_up(np.concatenate([held[kind][0], keys[often]]), np.concatenate([held[kind][1], n[often]]))
                    if len(held[kind][0]) > HELD:
                        yield from send(kind, *held[kind])
                        held[kind] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for kind, (keys, n) in held.items():
            yield from send(kind, keys, n)

    def build(table: pa.Table) -> pa.Table:
        m = _learn(table, bits, entry_bits)
        return pa.table({"shard": [m.low], "tokens": [int(m.counts.sum())], "types": [len(m.known)], "most": [int(m.counts.max(initial=0))], "words": [len(m.words)], "known": pa.array([m.known.tobytes()], pa.binary()), "counts": pa.array([m.counts.astype("<i8").tobytes()], pa.binary()), "filter": pa.array([m.words.tobytes()], pa.binary())})

    counted = texts.mapInArrow(count, "shard long, kind int, keys binary, n binary")
    return keep(counted.groupBy("shard").applyInArrow(build, "shard long, tokens long, types long, most long, words long, known binary, counts binary, filter binary"), "lm"), bits


def _layout(shards: int, types: int, words: int, wide: bool) -> list[tuple[str, int]]:
    return [("<u8", types), ("<u8", shards), ("<u8", shards), ("<u8", words), ("<i8" if wide else "<u4", types)]


def _views(flat: np.ndarray, at: int, layout: list[tuple[str, int]]) -> list[np.ndarray]:
    out = []
    for kind, n in layout:
        size = n * np.dtype(kind).itemsize
        out.append(flat[at : at + size].view(kind))
        at += size
    return out


def _itself(x: np.ndarray) -> np.ndarray:
    return x


class _Once:
    """An array that is let go as soon as it is pickled, before the JVM takes its copy."""

    def __init__(self, array: np.ndarray):
        self.array = array

    def __reduce__(self):
        array, self.array = self.array, None
        return _itself, (array,)


class Shared:
    """A range of shards in one flat array that is broadcast; the workers of an executor map its file."""

    def __init__(self, model: DataFrame, bits: int, low: int, sizes: np.ndarray):
        types, size = sizes[:, 0], sizes[:, 1]
        self.low, self.high, self.bits = low, low + len(sizes), bits
        self.layout = _layout(len(sizes), int(types.sum()), int(size.sum()), int(sizes[:, 2].max(initial=0)) >= 1 << 32)
        # Where the array begins in the pickled file, so that the numbers after the mark are aligned there.
        mark = np.frombuffer(_MAGIC * (1 << 16), np.uint8).copy()
        begins = pickle.dumps(_Once(mark), pickle.HIGHEST_PROTOCOL).find(_MAGIC)
        self.at = 16 + -(begins + 16) % 64
        flat = np.zeros(max(1 << 20, self.at + sum(n * np.dtype(k).itemsize for k, n in self.layout)), np.uint8)
        flat[:16] = np.frombuffer(_MAGIC, np.uint8)
        self.size = len(flat)
        known, first, size_, words, counts = _views(flat, self.at, self.layout)
        size_[:] = size
        first[:] = np.cumsum(size) - size
        at = np.cumsum(types) - types
        for r in model.where((F.col("shard") >= low) & (F.col("shard") < self.high)).select("shard", "known", "counts", "filter").toLocalIterator():
            k = r["shard"] - low
            known[at[k] : at[k] + types[k]] = np.frombuffer(r["known"], np.uint64)
            counts[at[k] : at[k] + types[k]] = np.frombuffer(r["counts"], "<i8")
            words[int(first[k]) : int(first[k] + size_[k])] = np.frombuffer(r["filter"], np.uint64)
        once = _Once(flat)
        del flat, known, first, size_, words, counts
        self.broadcast = model.sparkSession.sparkContext.broadcast(once)

    def model(self) -> Model:
        known, first, size, words, counts = _views(_mapped(self.broadcast, self.size), self.at, self.layout)
        return Model(self.low, self.high, self.bits, known, counts, first, size, words)


def share(model: DataFrame, bits: int, part: int = BROADCAST_PART) -> list[Shared]:
    """The whole model as broadcasts of about ``part`` bytes each, so that the driver holds no more at once."""
    sizes = np.zeros((1 << bits, 3), np.int64)
    for r in model.select("shard", "types", "words", "most").toLocalIterator():
        sizes[r[0]] = r[1:]
    number = np.cumsum(12 * sizes[:, 0] + 8 * sizes[:, 1]) // part
    cut = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), 1 << bits]
    return [Shared(model, bits, a, sizes[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def _mapped(shared: Broadcast, size: int) -> np.ndarray:
    """The broadcast array: mapped from its file where that can be found, else read."""
    path = getattr(shared, "_path", None)
    if path:
        try:
            with open(path, "rb") as f:
                at = f.read(4096).find(_MAGIC)
            if at >= 0:
                return np.memmap(path, np.uint8, "r", at, (size,))
        except (OSError, ValueError):
            pass
    return shared.value


def _probabilities(off: np.ndarray, c: np.ndarray, level: list[np.ndarray], n: int, v: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Base and smoothed probability of every token, from token counts and the levels of the n-grams that end there."""
    base = (c + 1) / (n + v + 1)
    smooth, held, begins = base, c.astype(np.float64), np.float64(texts)
    for k in level:
        before = np.empty_like(held)
        before[1:] = held[:-1]
        before[off[:-1]] = begins
        begins = np.float64(0)
        seen = np.where(k > 0, BASE ** (k.astype(np.float64) - 1), 0.0)
        held = np.minimum(seen, np.minimum(held, before))
        types = np.maximum(before, 1) ** TYPES
        smooth = np.where(before > 0, (held + types * smooth) / (before + types), smooth)
    return base, smooth


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(part: pa.RecordBatch, off: np.ndarray, c: np.ndarray, level: list[np.ndarray], n: int, v: int, texts: int) -> pa.RecordBatch:
    base, smooth = _probabilities(off, c, level, n, v, texts)
    add = lambda x: pa.array(np.add.reduceat(x, off[:-1]))  # noqa: E731  every text has its end token
    size = np.diff(off)
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), part.column("held_out"), pa.array(size), add((c > 0).astype(np.int64)), pa.array(np.full(len(size), n, np.int64)), add(np.log10(base)), add(np.log10(smooth))],
        [x.split()[0] for x in _SCORES.split(", ")],
    )


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", max_broadcast: int = 0, entry_bits: int = ENTRY_BITS, order: int = ORDER) -> DataFrame:
    """Train on the fold whose crc32(doc_id) mod 7 is not 2; score every text."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), held_out(key).alias("held_out"))
    size, texts = rows.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    if max_broadcast:
        model, bits = train(rows.where("not held_out"), entry_bits=entry_bits, order=order)
        total = model.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v"), F.sum(F.when(F.col("most") < 1 << 32, 12).otherwise(16) * F.col("types") + 8 * F.col("words")).alias("bytes")).first()
        if (total["bytes"] or 0) <= max_broadcast:
            return _score_with_copies(rows, share(model, bits), order, total["n"] or 0, total["v"] or 0, texts)
    return _score_in_shards(rows, shard_bits(size or 0), order, entry_bits, texts)


def _score_with_copies(rows: DataFrame, shared: list[Shared], order: int, n: int, v: int, texts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x.model() for x in shared]
        for batch in batches:
            for part, buf, offsets in B.chunks(batch, "text"):
                tokens, off, grams = sequences(buf, offsets, order)
                yield _scores(part, off, *look_up(parts, tokens, grams), n, v, texts)

    return rows.mapInArrow(run, _SCORES)


def answers_to(kinds: np.ndarray, raw: list[bytes], part: Model, order: int) -> list[bytes]:
    """Counts and levels for the packed hashes of many chunks, which one shard owns: a look-up for each ``_ANSWERS`` of a kind, not for each chunk."""
    none, data = np.zeros(0, np.uint64), [b""] * len(raw)
    for kind in range(1, order + 1):
        mine = np.flatnonzero(kinds == kind)
        size = np.array([len(raw[i]) // (8 if kind == 1 else 5) for i in mine], np.int64)
        for rows in np.split(np.arange(len(mine)), np.flatnonzero(np.diff((np.cumsum(size) - size) // _ANSWERS)) + 1):
            keys = [raw[i] for i in mine[rows]]
            c, level = look_up([part], np.frombuffer(b"".join(keys), np.uint64) if kind == 1 else none, [none if kind == 1 else _unpack_keys(keys, part.low, part.bits)])
            out, cut = c if kind == 1 else level[0], np.append(0, np.cumsum(size[rows])).tolist()
            for i, a, b in zip(mine[rows].tolist(), cut, cut[1:], strict=False):
                data[i] = out[a:b].tobytes()
    return data


def shard_bits(size: int) -> int:
    """Hash bits that name a shard, for so many bytes of text."""
    return max(11, int(size // _SHARD_BYTES).bit_length())


def _score_in_shards(rows: DataFrame, bits: int, order: int, entry_bits: int, texts: int) -> DataFrame:
    """Counts and questions go to the shards in one shuffle, answers come back to the text."""
    ship(rows.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, _, _ in B.chunks(batch, "text", _ASK_CHUNK):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "data"])
                chunk += 1

    def opened(data: pa.Buffer) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[np.ndarray]]:
        """A chunk, its tokens, their offsets, and its n-grams as they are sent."""
        part = pa.ipc.open_stream(data).read_next_batch()
        got = [sequences(buf, offsets, order) for _, buf, offsets in B.chunks(part, "text")]
        off = np.append(0, np.cumsum(np.concatenate([np.diff(x[1]) for x in got])))
        return part, np.concatenate([x[0] for x in got]), off, [_cut_hash(np.concatenate(g), bits) for g in zip(*(x[2] for x in got), strict=True)]

    def distinct(hashes: np.ndarray, kind: int) -> np.ndarray:
        return np.unique(hashes) if kind == 1 else _distinct(hashes, bits)[0]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                part, tokens, off, grams = opened(data.as_buffer())
                learnt = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False), np.diff(off))
                for kind, hashes in enumerate((tokens, *grams), 1):
                    keys = distinct(hashes, kind)
                    known, times = np.unique(hashes[learnt], return_counts=True) if kind == 1 else _distinct(hashes[learnt], bits)
                    n = np.zeros(len(keys), np.int64)
                    n[np.searchsorted(keys, known)] = times
                    of = chunk
                    while len(keys):  # counts are sent as u16; more in further rows, which ask nothing
                        shard, cut = _by_shard(keys, bits)
                        packed = _parts(keys.tobytes(), cut, 8) if kind == 1 else _parts(_pack_keys(keys, bits, cut), cut, 5)
                        yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array([of] * len(shard), pa.int64()), pa.array([kind] * len(shard), pa.int32()), packed, _counts(n, cut)], ["shard", "chunk", "kind", "keys", "n"])
                        more, of = n > 65535, None
                        keys, n = keys[more], n[more] - 65535

    def answer(table: pa.Table) -> pa.Table:
        own = _learn(table, bits, entry_bits)
        asked = table.filter(pc.is_valid(table.column("chunk")))
        data = answers_to(asked.column("kind").to_numpy(), asked.column("keys").to_pylist(), own, order)
        answers = asked.select(["shard", "chunk", "kind"]).append_column("data", pa.array(data, pa.binary()))
        sums = pa.table({"shard": [own.low], "tokens": [int(own.counts.sum())], "types": [len(own.known)]})
        return pa.concat_tables([answers, sums], promote_options="default").select(["shard", "chunk", "kind", "data", "tokens", "types"])

    chunks = keep(rows.mapInArrow(pack, "chunk long, data binary"), "chunks", wide=True)
    asked = chunks.mapInArrow(ask, "shard long, chunk long, kind int, keys binary, n binary")
    answers = keep(asked.groupBy("shard").applyInArrow(answer, "shard long, chunk long, kind int, data binary, tokens long, types long"), "answers", release=True)
    n, v = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("types")).first())

    def place(table: pa.Table, answers: pa.Table) -> pa.Table:
        part, tokens, off, grams = opened(table.column("data")[0].as_buffer())
        answers = answers.sort_by([("kind", "ascending"), ("shard", "ascending")])
        kind, data = answers.column("kind").to_numpy(), answers.column("data").to_pylist()
        got = []
        for k, hashes in enumerate((tokens, *grams), 1):
            own = np.frombuffer(b"".join(data[i] for i in np.flatnonzero(kind == k)), np.int64 if k == 1 else np.uint8)
            keys = distinct(hashes, k)
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            got.append(np.where(keys[at] == hashes, own[at], 0).astype(own.dtype) if len(keys) else np.zeros(len(hashes), own.dtype))
        return pa.Table.from_batches([_scores(part, off, got[0], got[1:], n, v, texts)])

    back = answers.where("chunk is not null").select("chunk", "kind", "shard", "data")
    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(place, _SCORES)
