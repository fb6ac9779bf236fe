"""Token counts without a pre-token shuffle.

Method: a first pass over all texts, in at most ``REPORTERS`` tasks, lets every task
report its most frequent pieces (so what shuffles has a bound); their sums give a compact table (64-bit piece hash -> token count) of at
most ``TABLE`` entries (pieces of at most ``PIECE_BYTES`` bytes), which is broadcast.  The second pass looks every piece up
there, and encodes misses once per worker in a bounded cache.  The table changes
only speed, never a count.

Defined cases: null text counts as empty (0 tokens); null or repeated ``doc_id``
values pass through; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import _bytes as B
from folio.llm import _tokens as T
from folio.session import keep, ship

#: Entries of the broadcast table: 12 bytes each, 786 kB in all.
TABLE = 1 << 16
#: Pieces a task reports, and those it tracks while it runs.
REPORT, TRACK = 1 << 14, 1 << 18
#: Bytes of a piece that is reported, at most; longer ones are left to the workers' caches.
PIECE_BYTES = 64
#: Tasks of the first pass, at most; each reads many splits of a large table.
REPORTERS = 1 << 13


def frequent_pieces(docs: DataFrame, tokenizer: str, text: str = "text", table: int = TABLE) -> list:
    """The most frequent pieces over all texts, as rows (hash, piece, first)."""
    ship(docs.sparkSession)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = T.worker_cache(tokenizer, ids=False).lib.family
        seen: dict[int, list] = {}
        for batch in batches:
            for _, buf, offsets in B.chunks(batch, "text"):
                starts, ends, _, h = T.cut(buf, offsets, family)
                short = ends - starts <= PIECE_BYTES
                starts, ends, h = starts[short], ends[short], h[short]
                uniq, first, count = np.unique(h, return_index=True, return_counts=True)
                top = np.argsort(-count, kind="stable")[:REPORT]
                begins = set(offsets[:-1].tolist())
                for u, i, c in zip(uniq[top].tolist(), first[top].tolist(), count[top].tolist(), strict=True):
                    if u in seen:
                        seen[u][0] += c
                    else:
                        s = int(starts[i])
                        seen[u] = [c, buf[s : ends[i]].tobytes(), s in begins]
                if len(seen) > TRACK:
                    seen = dict(sorted(seen.items(), key=lambda x: -x[1][0])[: TRACK // 2])
        best = sorted(seen.items(), key=lambda x: (-x[1][0], x[0]))[:REPORT]
        if best:
            keys = np.array([k for k, _ in best], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([v[0] for _, v in best]), pa.array([v[1] for _, v in best], pa.binary()), pa.array([v[2] for _, v in best])], ["hash", "n", "piece", "first"])

    found = docs.select(F.col(f"`{text}`").alias("text")).coalesce(REPORTERS).mapInArrow(report, "hash long, n long, piece binary, first boolean")
    counted = found.groupBy("hash").agg(F.sum("n").alias("n"), F.first("piece").alias("piece"), F.first("first").alias("first"))
    # Written first: else every task would send the driver its own candidates.
    return keep(counted.orderBy(F.desc("n"), "hash").limit(table), "pieces").collect()


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", limit: int = 4096, table: int = TABLE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    spark = docs.sparkSession
    rows = frequent_pieces(docs, tokenizer, text, table)
    hashes = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
    ids = T.Library(tokenizer).encode([bytes(r["piece"]) for r in rows], [r["first"] for r in rows]) if rows else []
    order = np.argsort(hashes)
    shared = spark.sparkContext.broadcast((hashes[order], np.array([len(x) for x in ids], np.int32)[order]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = T.worker_cache(tokenizer, ids=False)
        known, length = shared.value
        for batch in batches:
            for rows, buf, offsets in B.chunks(batch, "text"):
                n = cache.count(buf, offsets, known, length)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
