"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Method: each task tokenises the documents of its input split (no shuffle) and packs
``BATCH_IDS`` ids at a time.  A document longer than a window is first cut into full
windows; then pieces go, longest first, into the open window with the least room
that still holds them, found with a segment tree over remaining capacities.  A batch
has as many windows as its ids fill, and the ids beyond the last full one have windows
of power-of-two length, which need no padding; so every window ends up full.  A piece
that no open window holds opens the next one; when all are open, its head fills the
window with the most room, and the rest of it goes back among the pieces.  No window is
packed again.

Sequence ids are ``stretch * 2**32 + counter``: unique, and the same whenever a lost
task runs again over its split.  The stretch is the number of the split; with
:func:`pack_in_order` it is the number of the batch's first row in the files that were
read, so sequence ids follow the order of the rows, batch by batch.  Defined cases:
null text is empty (its piece is the end id alone); repeated or null ``doc_id`` values
are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import _bytes as B
from folio.llm import _tokens as T
from folio.session import ship

#: Ids packed together: about a thousand windows, 8 MB.
BATCH_IDS = 1 << 22
#: Bits of a sequence id for the number of the row a batch begins with, and for the windows of a batch (a batch has less than 2**32 ids).
ROW_BITS, WINDOW_BITS = 43, 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Open windows by remaining room; finds the tightest one that holds a length."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        if room:
            self.open.setdefault(room, []).append(window)
            self._add(room, 1)

    def most(self) -> tuple[int, int]:
        """(room, window) with the most room; it leaves the tree."""
        node = 1
        while node < self.leaves:
            node = 2 * node + (self.count[2 * node + 1] > 0)
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, window) with the least room of at least ``length``; it leaves the tree."""
        count, node = self.count, self.leaves + length
        while not count[node]:
            while node & 1:  # a right child: go up
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not count[node]:
                node += 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def stretch_id(row: int) -> int:
    if row >> ROW_BITS:
        raise ValueError(f"a table of 2**{ROW_BITS} rows or more has no sequence ids")
    return row << WINDOW_BITS


def pack_lengths(lengths: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length), for documents of these lengths."""
    windows: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []  # (-length, document, start): longest first
    for d, n in enumerate(lengths.tolist()):
        full = n // window
        windows += [[(d, k * window, window)] for k in range(full)]
        if n % window:
            rest.append((-(n % window), d, full * window))
    heapq.heapify(rest)
    still, over = divmod(-sum(x[0] for x in rest), window)
    tree = CapacityTree(window)
    for bit in range(over.bit_length()):
        if over >> bit & 1:
            tree.put(1 << bit, len(windows))
            windows.append([])
    while rest:
        n, d, start = heapq.heappop(rest)
        n = -n
        got = tree.take(n)
        if got is None and still:
            still -= 1
            windows.append([])
            got = window, len(windows) - 1
        if got is None:
            got = tree.most()
            heapq.heappush(rest, (got[0] - n, d, start + got[0]))
            n = got[0]
        windows[got[1]].append((d, start, n))
        tree.put(got[0] - n, got[1])
    return windows


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece; with ``with_ids`` also its ids as little-endian u32 bytes."""
    return _pack(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.lit(None).cast("long").alias("row")), tokenizer, end_id, window, with_ids)


def pack_in_order(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The same, with sequence ids that keep the order of the rows from batch to batch.

    Rows of Parquet files are numbered by file and place: files by folder, by the numbers of a
    writer's ``part-<task>...-c<counter>`` where names have them, then by name.  A table that is
    not read from Parquet files has the order of its partitions.
    """
    own = [F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")]
    try:
        placed = docs.select(*own, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        return pack_documents(docs, tokenizer, end_id, window, text, key, with_ids)
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    number = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("decimal(38,0)")
    files = placed.groupBy("file").agg(F.count(F.lit(1)).alias("n")).withColumn("folder", F.regexp_extract("file", r"^(.*)/[^/]*$", 1))
    before = Window.orderBy("folder", number(r"^part-(\d{1,30})"), number(r"-c(\d{1,30})\b"), name).rowsBetween(Window.unboundedPreceding, -1)
    first = files.select(F.col("file").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # One row for each file that the driver has listed to plan the scan.
    rows = placed.join(F.broadcast(first), F.col("file") == F.col("of")).select("doc_id", "text", (F.col("first") + F.col("at")).alias("row"))
    return _pack(rows, tokenizer, end_id, window, with_ids)


def _pack(rows: DataFrame, tokenizer: str, end_id: int, window: int, with_ids: bool) -> DataFrame:
    ship(rows.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, task = T.worker_cache(tokenizer), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        lengths: list[np.ndarray] = []
        sequence, held, first_of, next_row = 0, 0, None, None

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            flat, size = np.concatenate(ids).astype("<u4", copy=False), np.concatenate(lengths)
            first = np.cumsum(size) - size
            raw = memoryview(flat).cast("B")
            begin = (task << 32) + sequence if first_of is None else stretch_id(first_of)
            out = []
            for n, content in enumerate(pack_lengths(size, window), begin):
                offset = 0
                for d, start, length in content:
                    at = 4 * (int(first[d]) + start)
                    span = raw[at : at + 4 * length]
                    out.append((keys[d], start, length, zlib.crc32(span), int(size[d]), n, offset, bytes(span) if with_ids else None))
                    offset += length
                sequence += 1
            ids.clear(), keys.clear(), lengths.clear()
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            columns = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:7]]
            if with_ids:
                names.append("ids")
                columns.append(pa.array([x[7] for x in out], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for rows, buf, offsets in B.chunks(batch, "text"):
                row = rows.column("row")
                edge = [0, *(np.flatnonzero(np.diff(row.to_numpy()) != 1) + 1).tolist(), len(row)] if row.null_count == 0 else [0, len(row)]
                flat, off = cache.encode(buf, offsets, end_id)
                for a, b in zip(edge, edge[1:], strict=False):
                    now = row[a].as_py()
                    if keys and now != next_row:  # another file
                        yield flush()
                        held = 0
                    if not keys:
                        first_of = now
                    next_row = None if now is None else now + b - a
                    ids.append(flat[off[a] : off[b]])
                    keys += rows.column(0).slice(a, b - a).to_pylist()
                    lengths.append(np.diff(off[a : b + 1]))
                    held += int(off[b] - off[a])
                    if held >= BATCH_IDS:
                        yield flush()
                        held = 0
        if keys:
            yield flush()

    return rows.mapInArrow(pack, SCHEMA + (", ids binary" if with_ids else ""))
