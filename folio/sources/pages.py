"""Documents of any size: the ``pages`` array of one JSON file, read by many tasks.

A file is cut by the text reader at every ``separator`` (by default the brace that ends
an object), so its byte ranges go to different tasks, on any store Spark reads.  Whether a
range starts inside a string, and how deep, follows from what stands before it:

1. every task sums its range up: quotes (their parity) and nesting, for both cases of its start;
2. one row for each range, in order, gives every range its true start;
3. every task scans its range with that start, and gives the elements of the array ``pages``
   of the outermost object, and what else the object holds.  Elements that lie in one piece are
   passed on; only those that a range cuts are shuffled, to be put together;
4. elements are numbered by prefix sums over pieces of ranges.

Scanning is NumPy over at most ``PIECE_BYTES`` of a batch at a time; no task holds more than a
batch, what scanning needs for one piece or page, and the fields of the document beside its pages.

Defined cases: a file without the array, or with a null one, has no pages (with ``keep_empty``
one row whose ``page`` is null); a null element is a page without fields; text after the outermost object
is ignored; a page that does not parse keeps what can be read of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio import schemas
from folio.session import keep, ship

_QUOTE, _BACK = ord('"'), ord("\\")
_DEPTH = np.zeros(256, np.int64)
_DEPTH[list(b"{[")] = 1
_DEPTH[list(b"}]")] = -1
_PAGES = re.compile(rb'"pages"\s*:\s*\Z')
#: Bytes that are scanned at once; a longer run without a separator is scanned whole.
PIECE_BYTES = 2 << 20
_UNIT = "file string, part string, block long, unit int"


def _texts(spark: SparkSession, path: str, separator: str, folders: bool) -> DataFrame:
    """(file, part, block, value) in the order of each block; with ``folders`` a folder's files are one document, in the order of their names."""
    lines = spark.read.option("lineSep", separator).option("recursiveFileLookup", "true").text(path)
    whole = F.col("_metadata.file_path")
    file, part = (F.regexp_extract(whole, r"^(.*)/[^/]*$", 1), F.col("_metadata.file_name")) if folders else (whole, F.lit(""))
    return lines.select(file.alias("file"), part.alias("part"), F.col("_metadata.file_block_start").alias("block"), "value")


def _pieces(batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[tuple[str, str, int, np.ndarray]]:
    """(file, part, block, bytes) of each batch, cut where a file or block ends, and after ``PIECE_BYTES`` at the latest separator."""
    end = np.frombuffer(separator, np.uint8)
    for batch in batches:
        for key, rows in _spans(batch):
            values = rows.column("value").cast(pa.large_binary())
            offs = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
            raw = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
            at = 0
            while at < len(values):  # scanning takes about forty times the bytes it looks at
                stop = max(at + 1, int(np.searchsorted(offs, offs[at] + PIECE_BYTES, side="right")) - 1)
                yield *key, np.insert(raw[offs[at] : offs[stop]], np.repeat(offs[at + 1 : stop + 1] - offs[at], len(end)), np.tile(end, stop - at))
                at = stop


def _spans(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, str, int], pa.RecordBatch]]:
    block = batch.column("block").to_numpy()
    codes = [batch.column(c).dictionary_encode().indices.to_numpy() for c in ("file", "part")]
    new = np.flatnonzero((np.diff(block) != 0) | (np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)) + 1
    for a, b in zip([0, *new.tolist()], [*new.tolist(), len(batch)], strict=True):
        if b > a:
            yield (batch.column("file")[a].as_py(), batch.column("part")[a].as_py(), int(block[a])), batch.slice(a, b - a)


def scan(buf: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Which bytes are in a string (its quotes included), the nesting after each byte, from 0, and whether the text ends in a string."""
    back = buf == _BACK
    quote = buf == _QUOTE
    if back.any():
        # A quote after an odd number of backslashes is no end.
        at = np.arange(len(buf))
        other = np.maximum.accumulate(np.where(back, -1, at))
        run = np.zeros(len(buf), np.int64)
        run[1:] = (at - other)[:-1]
        quote &= run % 2 == 0
    opened = (np.cumsum(quote) + inside) % 2 == 1
    string = opened | quote
    return string, np.cumsum(np.where(string, 0, _DEPTH[buf])), bool(opened[-1]) if len(opened) else inside


def _block_states(texts: DataFrame, separator: bytes) -> DataFrame:
    """(file, part, block, inside, depth) at the start of each block."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[int]] = {}
        for *key, buf in _pieces(batches, separator):
            state = found.setdefault(tuple(key), [0, 0, 0, 1])  # nesting if it starts outside or inside a string, and where each case is now
            for case in (0, 1):
                _, depth, now = scan(buf, bool(state[2 + case]))
                state[case] += int(depth[-1]) if len(depth) else 0
                state[2 + case] = int(now)
        for (file, part, block), (out, within, flip, _) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, part, block, out, within, flip)], ["file", "part", "block", "out", "within", "flip"])

    sums = keep(texts.mapInArrow(sum_up, "file string, part string, block long, out long, within long, flip long"), "blocks")
    earlier = Window.partitionBy("file").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    started = sums.withColumn("inside", F.pmod(F.coalesce(F.sum("flip").over(earlier), F.lit(0)), F.lit(2)))
    nesting = F.when(F.col("inside") == 1, F.col("within")).otherwise(F.col("out"))
    return started.withColumn("own", nesting).select("file", "part", "block", (F.col("inside") == 1).alias("inside"), F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("depth"))


def _elements(buf: np.ndarray, string: np.ndarray, depth: np.ndarray, start: int, listed: bool | None) -> tuple[list[tuple[bool | None, bool, bool, bytes]], bytes, bool | None]:
    """Pieces (in pages, opens, ends, bytes) of the values below the outermost object, the object's own bytes, and whether the text ends in ``pages``.

    ``start`` is the nesting before the text, ``listed`` whether that is in ``pages`` (None: unknown).
    """
    before = np.concatenate([[start], depth[:-1]])
    deep = np.maximum(depth, before) >= 2
    edge = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    # Two values may touch: a value ends where the nesting falls from 2 to 1.
    ends = np.flatnonzero(deep & (before >= 2) & (depth < 2)) + 1
    bounds = np.unique(np.concatenate([edge, ends]))
    commas = np.flatnonzero((buf == 0x2C) & ~string & (depth == 2))
    raw, out, skeleton, last = buf.tobytes(), [], [], 0
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        if not deep[a]:
            continue
        begins, closed = before[a] < 2, depth[b - 1] < 2
        if begins:
            listed = raw[a : a + 1] == b"[" and before[a] == 1 and _PAGES.search(raw, max(0, a - 256), a) is not None
        skeleton.append(raw[last:a] + (raw[a : a + 1] if begins else b"") + (raw[b - 1 : b] if closed else b""))
        last = b
        if listed is not False:
            cuts = commas[(commas >= a) & (commas < b)].tolist()
            inner = [a + 1 if begins else a, *[c + 1 for c in cuts]]
            stops = [*cuts, b - 1 if closed else b]
            for k, (s, e) in enumerate(zip(inner, stops, strict=True)):
                out.append((listed, begins or k > 0, k < len(cuts) or closed, raw[s:e]))
        if closed:
            listed = False
    own = np.frombuffer(raw[last:], np.uint8)
    skeleton.append(own[(before[last:] > 0) | (depth[last:] > 0)].tobytes() if len(own) else b"")
    return out, b"".join(skeleton), listed


def page_elements(spark: SparkSession, path: str, separator: str = "}", folders: bool = False) -> tuple[DataFrame, DataFrame]:
    """((file, pos, element) of every element of ``pages``, (file, fields) with the rest of each document as JSON)."""
    ship(spark)
    texts, end = _texts(spark, path, separator, folders), separator.encode()
    states = _block_states(texts, end)
    starts = spark.sparkContext.broadcast({(r.file, r.part, r.block): (r.inside, r.depth) for r in states.toLocalIterator()})  # a row for each block that a task reads

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unit, inside, depth, listed = None, 0, False, 0, None
        for file, part, block, buf in _pieces(batches, end):
            if (file, part, block) != now:
                now, unit = (file, part, block), 0
                inside, depth = starts.value[now]
                listed = False if depth < 2 and not inside else None
            if not len(buf):
                continue
            string, nest, inside = scan(buf, inside)
            pieces, skeleton, listed = _elements(buf, string, nest + depth, depth, listed)
            depth += int(nest[-1])
            known, opens = listed, 0
            rows = []
            for k, (mine, begins, done, text) in enumerate(pieces):
                opens = opens if mine is None or (k and pieces[k - 1][0] is not None) else 0
                opens += begins
                rows.append((k, mine, begins, done, opens, text.decode("utf-8", "replace"), None, None))
            rows.append((-1, None, False, True, 0, None, skeleton.decode("utf-8", "replace"), known))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            keys = [pa.array([x] * len(rows), t) for x, t in ((file, pa.string()), (part, pa.string()), (block, pa.int64()), (unit, pa.int32()))]
            yield pa.RecordBatch.from_arrays(keys + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "part", "block", "unit", "k", "listed", "begins", "done", "opens", "text", "fields", "after"])
            unit += 1

    schema = f"{_UNIT}, k int, listed boolean, begins boolean, done boolean, opens long, text string, fields string, after boolean"
    found = keep(texts.mapInArrow(cut, schema), "elements")
    return _numbered(found), _fields(found)


def _fields(found: DataFrame) -> DataFrame:
    place = F.struct("part", "block", "unit")
    rest = found.where("k < 0 and fields <> ''").groupBy("file").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "fields"))).alias("f"))
    return rest.select("file", F.array_join(F.transform("f", lambda x: x["fields"]), "").alias("fields"))


def _numbered(found: DataFrame) -> DataFrame:
    unit = ["file", "part", "block", "unit"]
    ordered = Window.partitionBy("file").orderBy("part", "block", "unit")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    begun = lambda c: F.sum(F.when(F.col("begins") & c, 1).otherwise(0))
    units = found.groupBy(*unit).agg(F.max("after").alias("after"), begun(F.col("listed").isNull()).alias("loose"), begun(F.coalesce("listed", F.lit(False))).alias("sure"))
    # Whether a unit starts inside the array is what the last unit before it that knew says.
    units = units.withColumn("within", F.coalesce(F.last("after", ignorenulls=True).over(earlier), F.lit(False)))
    units = units.withColumn("mine", F.when(F.col("within"), F.col("loose")).otherwise(0))
    units = units.withColumn("first", F.coalesce(F.sum(F.col("mine") + F.col("sure")).over(earlier), F.lit(0))).select(*unit, "within", "mine", "first")
    rows = found.where("k >= 0").join(units, unit).where(F.coalesce("listed", F.col("within")))
    rows = rows.withColumn("pos", F.col("first") + F.when(F.col("listed").isNull(), F.col("opens")).otherwise(F.col("mine") + F.col("opens")) - 1)
    whole = F.col("begins") & F.col("done")
    broken = rows.where(~whole).groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("part", "block", "unit", "k", "text"))).alias("t"))
    broken = broken.select("file", "pos", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("element"))
    out = rows.where(whole).select("file", "pos", F.col("text").alias("element")).unionByName(broken)
    return out.where(F.trim(F.regexp_replace("element", r"\s+", " ")) != "")  # an empty array has one blank element


def read_large_documents(spark: SparkSession, path: str, separator: str = "}", folders: bool = False) -> tuple[DataFrame, DataFrame]:
    """((source_pdf, pos, p) with every page as the model's struct, (engine, source_pdf) of every document)."""
    elements, rest = page_elements(spark, path, separator, folders)
    docs = rest.withColumn("d", F.from_json("fields", "engine string, source_pdf string")).select("file", "d.engine", "d.source_pdf")
    rows = elements.join(docs.select("file", "source_pdf"), "file")
    return rows.select("source_pdf", "pos", F.from_json("element", schemas.PAGE_FIELDS, {"mode": "PERMISSIVE"}).alias("p")), docs.select("engine", "source_pdf")


def read_pages(spark: SparkSession, path: str, keep_empty: bool = False, separator: str = "}", folders: bool = False) -> DataFrame:
    """What ``explode_pages`` makes of ``read_documents``, page by page from the start."""
    from folio.sources.documents import page_rows

    pages, docs = read_large_documents(spark, path, separator, folders)
    if keep_empty:
        pages = docs.select("source_pdf").join(pages, "source_pdf", "left")
    return page_rows(pages)
