"""Removal of byte strings of ``LENGTH`` bytes that also start earlier in the corpus.

Every window of LENGTH bytes is owned by the anchor inside it: the place of its
smallest KGRAM-byte hash (the leftmost of equals), which depends on nothing but the
window, so equal windows have equal anchors.  The windows that one anchor owns in a
text are consecutive; the bytes they cover are a context of at most 2 * LENGTH bytes.

1.  A pass over all texts sends one packed entry per context (about one per 40
    bytes): hashes of anchor and context, place, number of windows.  Contexts that
    repeat inside a stretch of text are settled there and only their first goes on.
2.  By anchor: contexts of equal hashes form a group.  Its earliest and the one after it
    are a pair that the arrays compare below; later ones are covered as that pair says by
    hash.  The earliest contexts of an anchor with several are compared below too.
    Buckets with more than their share of the entries (an anchor in very many
    surroundings, or a context in very many texts) are settled row by row instead, with
    map-side sums, so that no task gets a whole anchor.
3.  Only texts that hold such contexts shuffle.  Their contexts meet in buckets (those of a
    pair by the two documents and a stretch of the first; contexts that overlap are sent as
    one run of bytes), where a suffix array (``suffix``) and its adjacent common prefixes find equal windows;
    all but the earliest are covered.  An anchor with more than ``PART`` contexts is
    dealt over several buckets, whose earliest windows are compared by hash.
4.  Covered windows are united per document; other documents never shuffle.

Defined cases: a null text is empty; a row with a null ``doc_id`` is returned whole and
never counts as earlier; rows that repeat a ``doc_id`` share their covered places, cut
to each text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import _bytes as B
from folio.llm import suffix
from folio.llm._skew import attach
from folio.llm.exact_dedup import member_filter, with_maybe
from folio.session import keep, ship

LENGTH, KGRAM = 100, 24
#: Contexts of an anchor that meet in one bucket, at most.
PART = 4096
#: A bucket is heavy with so many times its share of all entries, and so many at least.
HEAVY, HEAVY_LEAST = 4, 1 << 18
#: Bytes of the earlier text whose pairs meet in one bucket (a power of two).
STRETCH_BITS = 17
_REACH = LENGTH - KGRAM + 1  # k-grams in a window
_SEGMENT = 1 << 23
_PLACE = np.uint64((1 << 24) - 1)


def _smallest(h: np.ndarray) -> np.ndarray:
    """Place of the smallest hash (leftmost of equals) among the _REACH from each position."""
    x = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= _REACH:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    x = np.minimum(x[: len(x) - (_REACH - width)], x[_REACH - width :])
    return (x & _PLACE).astype(np.int64)


def contexts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor hash, context hash, row, start in the row's bytes and number of windows of every context."""
    parts = []
    prefix = B.prefix_hash(buf)
    row_end = offsets[1:]
    for at in range(0, len(buf) - LENGTH + 1, _SEGMENT):
        stop = min(at + _SEGMENT, len(buf) - LENGTH + 1)
        grams = np.arange(at, stop + _REACH - 1)
        h = B.span_hash(prefix, grams, grams + KGRAM)
        anchor = _smallest(h) + at
        window = np.arange(at, stop)
        row = np.searchsorted(offsets, window, side="right") - 1
        inside = window + LENGTH <= row_end[row]
        new = np.ones(len(window), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        count = np.add.reduceat(inside.astype(np.int64), first)
        ok = inside[first]  # windows that end past the text come last in their row
        first, count = first[ok], count[ok]
        begin = window[first]
        own = anchor[first]
        parts.append((h[own - at], B.span_hash(prefix, begin, begin + count - 1 + LENGTH) ^ B.mix((own - begin).astype(np.uint64)), row[first], begin - offsets[row[first]], count))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_ENTRY = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("windows", "<u2")])
_COVER = np.dtype([("doc", "<i8"), ("start", "<i4"), ("windows", "<u2")])
_PAIR = np.dtype([*_COVER.descr, ("first_doc", "<i8"), ("first_start", "<i4")])
_PAIR_COLUMNS = "first_doc long, first_start long"


def _earliest(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order of anchor, context, place; and which are the first of their context."""
    e = e[np.lexsort((e["start"], e["doc"], e["context"], e["anchor"]))]
    first = np.ones(len(e), bool)
    first[1:] = (e["anchor"][1:] != e["anchor"][:-1]) | (e["context"][1:] != e["context"][:-1])
    # The same place sent twice (a row that is repeated) covers nothing.
    again = np.zeros(len(e), bool)
    again[1:] = ~first[1:] & (e["doc"][1:] == e["doc"][:-1]) & (e["start"][1:] == e["start"][:-1])
    group = np.cumsum(first) - 1
    head = np.flatnonzero(first)
    again |= ~first & (e["doc"] == e["doc"][head][group]) & (e["start"] == e["start"][head][group]) if len(e) else again
    return e[~again], first[~again]


def _take(e: np.ndarray, kind: np.dtype) -> np.ndarray:
    out = np.empty(len(e), kind)
    for c in kind.names:
        if c in e.dtype.names:
            out[c] = e[c]
    return out


def _pairs(e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The second of every group with its first, and the later ones, from the order of :func:`_earliest`."""
    second = np.zeros(len(e), bool)
    second[1:] = first[:-1] & ~first[1:]
    pairs = _take(e[second], _PAIR)
    head = e[np.flatnonzero(second) - 1]
    pairs["first_doc"], pairs["first_start"] = head["doc"], head["start"]
    return pairs, _take(e[~first & ~second], _COVER)


def settle(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc, start, windows, anchor, size, first_doc, first_start): contexts to be compared by anchor, pairs to be compared (first_doc), and windows covered if those are (neither)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for part, buf, offsets in B.chunks(batch, "text"):
                anchor, context, row, start, count = contexts(buf, offsets)
                if not len(row):
                    continue
                e = np.empty(len(row), _ENTRY)
                e["anchor"], e["context"], e["doc"], e["start"], e["windows"] = anchor, context, part.column("doc_id").to_numpy()[row], start, count
                e, first = _earliest(e)
                here = _pairs(e, first)
                e = e[first]
                bucket = (e["anchor"] % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket.astype(np.uint16 if buckets <= 65536 else np.int64), kind="stable")
                bucket, raw = bucket[by], e[by].tobytes()
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = [_ENTRY.itemsize * x for x in [*cut.tolist(), len(bucket)]]
                blobs, target, kind, count = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], bucket[cut].tolist(), [0] * len(cut), np.diff(np.append(cut, len(bucket))).tolist()
                for k, some in ((1, here[1]), (2, here[0])):  # settled here; some bucket hands them on
                    if len(some):
                        blobs.append(some.tobytes())
                        target.append((int(e["anchor"][0] >> np.uint64(20)) + turn) % buckets)
                        kind.append(k)
                        count.append(0)
                        turn += 1
                yield pa.RecordBatch.from_arrays([pa.array(target, pa.int64()), pa.array(kind, pa.int32()), pa.array(count, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "kind", "entries", "data"])

    def meet(table: pa.Table) -> pa.Table:
        kind, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        e, first = _earliest(np.frombuffer(b"".join(d for k, d in zip(kind, data, strict=True) if k == 0), _ENTRY))
        handed = [np.frombuffer(b"".join(d for k, d in zip(kind, data, strict=True) if k == which), dtype) for which, dtype in ((1, _COVER), (2, _PAIR))]
        pairs, covered = _pairs(e, first)
        pairs, covered = np.concatenate([handed[1], pairs]), np.concatenate([handed[0], covered])
        rest = e[first]
        new = np.ones(len(rest), bool)
        new[1:] = rest["anchor"][1:] != rest["anchor"][:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(rest))) if len(rest) else np.zeros(0, np.int64)
        size = np.repeat(size, size)
        rest, size = rest[size > 1], size[size > 1]
        n = [len(covered), len(pairs), len(rest)]
        out = {c: np.concatenate([covered[c], pairs[c], rest[c]]).astype(np.int64) for c in _COVER.names}
        only = lambda x, k: pa.array(np.concatenate([np.zeros(sum(n[:k]), np.int64), x, np.zeros(sum(n[k + 1 :]), np.int64)]), mask=np.repeat(np.arange(3) != k, n))
        out["anchor"], out["size"] = only(rest["anchor"].view(np.int64), 2), only(size, 2)
        out["first_doc"], out["first_start"] = only(pairs["first_doc"], 1), only(pairs["first_start"].astype(np.int64), 1)
        return pa.table(out)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "start", "windows", "anchor", "context", "first_doc", "first_start"]
        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                e = np.frombuffer(data.as_buffer(), (_ENTRY, _COVER, _PAIR)[kind])
                yield pa.RecordBatch.from_arrays([pa.array(e[c].astype(np.int64)) if c in e.dtype.names else pa.nulls(len(e), pa.int64()) for c in names], names)

    found = f"doc long, start long, windows long, anchor long, size long, {_PAIR_COLUMNS}"
    sent = keep(docs.mapInArrow(send, "bucket long, kind int, entries long, data binary"), "sent")
    loads = keep(sent.groupBy("bucket").agg(F.sum("entries").alias("load")), "loads")
    total = loads.agg(F.sum("load")).first()[0] or 0
    heavy = loads.where(F.col("load") > max(HEAVY * total // buckets, HEAVY_LEAST)).select(F.col("bucket").alias("__heavy"))
    light = sent.join(heavy, F.col("bucket") == F.col("__heavy"), "left_anti").select("bucket", "kind", "data").groupBy("bucket").applyInArrow(meet, found)
    if heavy.isEmpty():
        return keep(light, "contexts")
    rows = keep(sent.join(heavy, F.col("bucket") == F.col("__heavy"), "left_semi").mapInArrow(unpack, f"doc long, start long, windows long, anchor long, context long, {_PAIR_COLUMNS}"), "heavy")
    entries, total = rows.where("anchor is not null"), rows.count()
    first = F.min(F.struct("doc", "start")).alias("first")
    groups = keep(entries.groupBy("anchor", "context").agg(first, F.first("windows").alias("own_windows"), F.count(F.lit(1)).alias("n")), "groups")
    sizes = keep(groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    place, none = F.struct("doc", "start"), lambda name: F.lit(None).cast("long").alias(name)
    later = keep(attach(entries, groups.where("n > 1").select("anchor", "context", "first", "n"), ["anchor", "context"], "n", total).where(place != F.col("first")), "later")
    seconds = later.groupBy("anchor", "context").agg(F.min(F.struct("doc", "start", "windows")).alias("second"), F.first("first").alias("first"), F.count(F.lit(1)).alias("n"))
    pairs = seconds.select("second.doc", "second.start", "second.windows", none("anchor"), none("size"), F.col("first.doc").alias("first_doc"), F.col("first.start").alias("first_start"))
    third = attach(later.drop("first", "n"), seconds.select("anchor", "context", "second", "n"), ["anchor", "context"], "n", total).where(place != F.struct("second.doc", "second.start"))
    handed = rows.where("anchor is null").select("doc", "start", "windows", "anchor", none("size"), "first_doc", "first_start")
    covered = handed.unionByName(third.select("doc", "start", "windows", none("anchor"), none("size"), none("first_doc"), none("first_start")))
    rest = attach(groups.select(F.col("first.doc").alias("doc"), F.col("first.start").alias("start"), F.col("own_windows").alias("windows"), "anchor"), sizes, ["anchor"], "size", total)
    rest = rest.select("doc", "start", "windows", "anchor", "size", none("first_doc"), none("first_start"))
    return keep(light.unionByName(covered).unionByName(pairs).unionByName(rest), "contexts")


def _with_texts(docs: DataFrame, lists: DataFrame, rows: int) -> DataFrame:
    """The texts of the documents in ``lists`` (doc, items); a bounded filter keeps the others out of the shuffle."""
    maps, bits = member_filter(lists.select(F.col("doc").alias("print")), rows)
    likely = with_maybe(docs.withColumn("print", F.col("doc_id")), maps, bits).where("maybe").select("doc_id", "text")
    return likely.join(lists, F.col("doc_id") == F.col("doc"))


def compare(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Covered windows (doc, start, windows) among contexts of equal anchors and in pairs of contexts."""
    asked, pairs = entries.where("anchor is not null"), entries.where("first_doc is not null")
    count = asked.count() + 2 * pairs.count()
    buckets = max(256, count // 8000)
    part = F.pmod(F.xxhash64("doc", "start"), F.ceil(F.col("size") / PART))
    by_anchor = asked.select("doc", "start", "windows", F.pmod(F.xxhash64("anchor", part), F.lit(buckets)).alias("bucket"), (F.col("size") > PART).alias("split"))
    meet = F.pmod(F.xxhash64("first_doc", "doc", F.shiftright("first_start", STRETCH_BITS)), F.lit(buckets)).alias("bucket")
    in_pairs = [pairs.select(F.col(d).alias("doc"), F.col(at).alias("start"), "windows", meet, F.lit(False).alias("split")) for d, at in (("doc", "start"), ("first_doc", "first_start"))]
    lists = by_anchor.unionByName(in_pairs[0]).unionByName(in_pairs[1]).groupBy("doc").agg(F.collect_list(F.struct("start", "windows", "bucket", "split")).alias("items"))
    lists = keep(lists, "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, items = batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("items")
            out: list[tuple] = []
            for doc, text, mine in zip(docs, texts, items, strict=True):
                raw = memoryview(text.as_buffer() if text.is_valid else b"")
                x = mine.values
                start, end, bucket, split = (x.field(c).to_numpy(zero_copy_only=False) for c in ("start", "windows", "bucket", "split"))
                end = start + end
                ok = end - 1 + LENGTH <= len(raw)
                start, end, bucket, split = start[ok], end[ok], bucket[ok], split[ok]
                order = np.lexsort((start, split, bucket))
                start, end, bucket, split = start[order], end[order], bucket[order], split[order]
                new = np.ones(len(start), bool)  # windows that follow each other are one run
                new[1:] = (bucket[1:] != bucket[:-1]) | (split[1:] != split[:-1]) | (start[1:] > end[:-1])
                first = np.flatnonzero(new)
                end = np.maximum.reduceat(end, first) if len(first) else end
                out += [(k, doc, a, bytes(raw[a : b - 1 + LENGTH]), w) for k, a, b, w in zip(bucket[first].tolist(), start[first].tolist(), end.tolist(), split[first].tolist(), strict=True)]
            for at in range(0, len(out), 20_000):
                c = list(zip(*out[at : at + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1]), pa.array(c[2]), pa.array(c[3], pa.binary()), pa.array(c[4])], ["bucket", "doc", "start", "bytes", "split"])

    def sort(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        t, offsets = B.text_buffer(table.column("bytes"))
        w = suffix.words_at(t)
        sa = suffix.suffix_array(t, w)
        same = suffix.shared(sa, w, LENGTH)
        row = np.searchsorted(offsets, sa, side="right") - 1
        whole = sa + LENGTH <= offsets[row + 1]
        group = np.cumsum(~same)[whole]
        sa, row = sa[whole], row[whole]
        doc = table.column("doc").to_numpy()[row]
        start = table.column("start").to_numpy()[row] + sa - offsets[row]
        order = np.lexsort((start, doc, group))
        group, doc, start, sa, row = group[order], doc[order], start[order], sa[order], row[order]
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        head = np.flatnonzero(first)
        mine = np.cumsum(first) - 1
        later = ~first & ((doc != doc[head][mine]) | (start != start[head][mine])) if len(first) else first
        # The earliest windows of anchors that are dealt over several buckets go on, by hash.
        split = np.asarray(table.column("split").to_numpy(zero_copy_only=False))[row] & first
        prefix = B.prefix_hash(t)
        h = B.span_hash(prefix, sa[split], sa[split] + LENGTH)
        h2 = B.mix(w[sa[split]] + B.COMBINE[5] * w[sa[split] + 40] + B.COMBINE[6] * w[sa[split] + 88])
        n1, n2 = int(later.sum()), int(split.sum())
        c_doc, c_start, c_windows = runs(doc[later], start[later])
        n1 = len(c_doc)
        return pa.table(
            {
                "doc": np.append(c_doc, doc[split]),
                "start": np.append(c_start, start[split]),
                "windows": np.append(c_windows, np.ones(n2, np.int64)),
                "h": pa.array(np.append(np.zeros(n1, np.int64), h.view(np.int64)), mask=np.arange(n1 + n2) < n1),
                "h2": pa.array(np.append(np.zeros(n1, np.int64), h2.view(np.int64)), mask=np.arange(n1 + n2) < n1),
            }
        )

    cuts = _with_texts(docs, lists, count).select("doc_id", "text", "items").mapInArrow(cut, "bucket long, doc long, start long, bytes binary, split boolean")
    found = keep(cuts.groupBy("bucket").applyInArrow(sort, "doc long, start long, windows long, h long, h2 long"), "suffixes")
    open_ = found.where("h is not null")
    earliest = open_.groupBy("h", "h2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A window's hash comes at most once from each bucket.
    merged = open_.join(earliest, ["h", "h2"]).where(F.struct("doc", "start") != F.col("first")).select("doc", "start", "windows")
    return found.where("h is null").select("doc", "start", "windows").unionByName(merged)


def runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (doc, start) as runs of consecutive starts: doc, first start, number."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return doc[first], start[first], start[last] - start[first] + 1


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans and the remaining bytes (``kept``), or their ``kept_sha256`` with ``digest``."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = docs.where("doc_id is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    entries = settle(known, max(512, int(size // (16 << 20))))
    covers = entries.where("anchor is null and first_doc is null").select("doc", "start", "windows").unionByName(compare(known, entries))
    lists = keep(covers.groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("items")), "covered")
    count = lists.count()
    last = "kept_sha256 string" if digest else "kept binary"
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, {last}"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, items in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("items"), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                x = items.values
                start, windows = x.field("start").to_numpy(), x.field("windows").to_numpy()
                start = np.minimum(start, len(raw))
                end = np.minimum(start + windows - 1 + LENGTH, len(raw))
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, end, -1)
                gone = np.cumsum(edge)[:-1] > 0
                change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                left = raw[~gone].tobytes()
                out.append((doc, len(raw), int(gone.sum()), len(change) // 2, [{"start": int(a), "end": int(b)} for a, b in zip(change[::2], change[1::2], strict=True)], hashlib.sha256(left).hexdigest() if digest else left))
            c = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string() if digest else pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(c, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", last.split()[0]])

    maps, bits = member_filter(lists.select(F.col("doc").alias("print")), count)
    flagged = with_maybe(docs.withColumn("print", F.col("doc_id")), maps, bits)
    maybe = flagged.where("maybe and doc_id is not null").select("doc_id", "text").join(lists, F.col("doc_id") == F.col("doc"), "left")
    whole = F.coalesce("text", F.lit(""))
    plain = lambda rows: rows.select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), (F.sha2(whole, 256).alias("kept_sha256") if digest else whole.cast("binary").alias("kept")))
    through = plain(flagged.where("not maybe or doc_id is null"))
    cut_ = maybe.where("items is not null").select("doc_id", "text", "items").mapInArrow(remove, schema)
    return through.unionByName(plain(maybe.where("items is null"))).unionByName(cut_)
