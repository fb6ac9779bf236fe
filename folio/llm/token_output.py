"""Token-id output: documents -> patched frame-of-reference segment files -> documents.

Method: a range shuffle puts the documents in ascending ``doc_id`` order, each task
encodes its range with the tokenizer (see ``_tokens``) and cuts the ids into
segments (see ``pfor``).  A segment is one row of a Parquet file, so any store that
Spark reads can hold it; index columns give documents per segment, their lengths and the
ids before it in its range, the payload gives block starts.  A reader adds what the ranges
before hold, one number for each, so no payload shuffles.

Defined cases: a null text is an empty text (only the end id); rows with a null
``doc_id`` come first; rows that repeat a ``doc_id``, or have none, are documents of
their own, ordered by a hash of the text and then the text, so many of them are not one
range; an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm import _bytes as B
from folio.llm import _tokens as T
from folio.llm import pfor
from folio.session import ship

#: Ids of a segment; a longer document has a segment of its own.
SEGMENT_IDS = 1 << 21
FILES = "part int, segment int, before long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, text: str = "text", key: str = "doc_id", percentile: float = 0.9) -> None:
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, segment = T.worker_cache(tokenizer), TaskContext.get().partitionId(), 0
        before = 0
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal segment, before
            flat = np.concatenate(ids)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([before]), pa.array([len(flat)]), pa.array([list(keys)], pa.list_(pa.int64())), pa.array([list(lengths)], pa.list_(pa.int64())), pa.array([pfor.encode(flat, percentile)], pa.binary())],
                ["part", "segment", "before", "n_ids", "doc_ids", "lengths", "payload"],
            )
            segment, before = segment + 1, before + len(flat)
            ids.clear(), keys.clear(), lengths.clear()
            return row

        held = 0
        for batch in batches:
            for rows, buf, offsets in B.chunks(batch, "text"):
                flat, off = cache.encode(buf, offsets, end_id)
                ids.append(flat)
                keys += rows.column(0).to_pylist()
                lengths += np.diff(off).tolist()
                held += len(flat)
                if held >= SEGMENT_IDS:
                    yield flush()
                    held = 0
        if keys:
            yield flush()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(encode, FILES).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens and token_ids, or ids_crc32 with ``digest``."""
    ship(spark)
    files = spark.read.schema(FILES).parquet(path)
    # A range knows its own prefix sums; one row per range (write task) gives what the ranges before hold.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("outer"))
    placed = files.join(F.broadcast(parts), "part").select((F.col("before") + F.col("outer")).alias("base"), "doc_ids", "lengths", "payload")
    value = "ids_crc32 long" if digest else "token_ids array<int>"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, keys, lengths, payload in zip(*(batch.column(k) for k in range(4)), strict=True):
                ids = pfor.Segment(payload.as_py()).decode()
                off = np.zeros(len(lengths) + 1, np.int64)
                np.cumsum(lengths.values.to_numpy(), out=off[1:])
                if digest:
                    raw, at = memoryview(ids.astype("<u4")).cast("B"), (4 * off).tolist()
                    last = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(base.as_py() + off[:-1]), lengths.values, last], ["doc_id", "start", "n_tokens", value.split()[0]])

    return placed.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {value}")
