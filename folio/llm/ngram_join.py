"""Near-duplicate join: documents whose 5-word shingle sets have Jaccard >= 0.75.

1.  One pass describes every document: number of shingles, a signature of the set,
    and a vector that counts the set's shingles in hash groups, about four to a group
    (a power of two, so that vectors of two sizes fold to one).  It also reports shingles that are frequent in a stretch of text; the most frequent ones
    (a bounded table) go last in the order of step 2, which changes only speed.
2.  Two sets with Jaccard >= 0.75 share a shingle among the first
    n - ceil(0.75 n) + 1 of each in any common order.  A second pass sends those,
    packed by bucket and once per set, and keeps runs of sets that share one.
3.  A run of at most ``SMALL_RUN`` sets gives its pairs, without those whose sizes, or
    the places of the shared shingle, leave too little to share; a longer run is
    indexed as an R-tree over its count vectors and searched.  The overlap of two sets is at most
    the sum of the coordinate minima of their vectors, so a pair or subtree whose
    bound is too low is dropped.  Of what survives, a run gives a spanning forest.
4.  Connected survivors form blocks, and the texts of a block (only these shuffle)
    meet in a task, which compares exact sets, every pair once, through an inverted
    index of those that follow.  It adds up the links of each set, and gives links that
    span the same components as all of them.
5.  Components over verified links, and copies of a set by its signature.  A document's
    ``n_links`` are the copies of its set and the documents of all linked sets.

Large groups: the entries of step 2 are counted by bucket and, in buckets with more than
their share, by shingle, over all texts.  A run of more than ``PART`` sets and a block of
more than ``BLOCK_PART`` documents are split into parts of that size, and each pair of
parts meets in a task of its own, so memory is bounded.

Defined cases: a null, empty or blank text has no shingles and is linked with nothing;
fewer than five words are one shingle; rows that repeat a ``doc_id`` are
judged one by one and may carry different components; a
null ``doc_id`` has a null component and no links; an empty table gives no rows; other columns are
ignored (or pass through :func:`drop_near_duplicates`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import _bytes as B
from folio.llm._components import connected_components
from folio.llm._skew import attach
from folio.llm.exact_dedup import member_filter, with_maybe, without_ids
from folio.session import keep, ship

WORDS, GROUPS, MOST_GROUPS = 5, 64, 1 << 16
#: Jaccard >= NUM/DEN.
NUM, DEN = 3, 4
#: Frequent shingles kept for the order; runs whose pairs are listed; sets in a part of a split run; documents in a part of a split block.
FREQUENT, SMALL_RUN, PART, BLOCK_PART = 1 << 16, 8, 8192, 4096
#: A bucket is heavy with so many times its share of the entries.
HEAVY = 4
_FULL = 255
_ENTRY = np.dtype([("key", "<u8"), ("sig", "<i8"), ("n", "<u4"), ("place", "<u4")])


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending inside each row, and the row of each."""
    h, at = B.word_hashes(buf, offsets)
    grams, first = B.ngrams(h, at, WORDS)
    row = np.searchsorted(at, first, side="right") - 1
    n = np.diff(at)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(WORDS - 1):
            has = n[short] > k
            whole[has] += h[at[short[has]] + k] * B.COMBINE[8 + k]
        grams, row = np.concatenate([grams, B.mix(whole + n[short].astype(np.uint64))]), np.concatenate([row, short])
    return _sorted_sets(grams, row, len(n))


def _sorted_sets(grams: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams)
    small = row[order].astype(np.uint16 if rows <= 65536 else np.int64)
    order = order[np.argsort(small, kind="stable")]
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], row[new]


def _row_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    at = np.searchsorted(row, np.arange(rows + 1))
    return total[at[1:]] - total[at[:-1]]


def _signature(grams: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    return B.mix(_row_sums(B.mix(grams), row, rows)).view(np.int64), B.mix(_row_sums(B.mix(grams ^ B.COMBINE[3]), row, rows)).view(np.int64)


def group_counts(n: np.ndarray) -> np.ndarray:
    """Groups of the count vector of sets with n shingles."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) / 4)).clip(0).astype(np.int64), GROUPS, MOST_GROUPS)


def _chunked_text(batch: pa.RecordBatch):
    yield from B.chunks(batch, "text")


def describe(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, n, sig, sig2, vec), and of frequent shingles (``hot``: hashes and counts)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "sig", "sig2", "vec", "hot"]
        for batch in batches:
            for part, buf, offsets in _chunked_text(batch):
                rows = len(offsets) - 1
                grams, row = shingle_sets(buf, offsets)
                sig, sig2 = _signature(grams, row, rows)
                n = np.bincount(row, minlength=rows).astype(np.int64)
                groups = group_counts(n)
                at = np.cumsum(groups) - groups
                vec = np.minimum(np.bincount(at[row] + ((grams >> np.uint64(40)).astype(np.int64) & (groups[row] - 1)), minlength=int(groups.sum())), _FULL).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(sig), pa.array(sig2), pa.array([vec[a : a + k] for a, k in zip(at.tolist(), groups.tolist(), strict=True)], pa.binary()), pa.nulls(rows, pa.binary())], names)
                # each set once, so that plain copies do not make their shingles look frequent
                _, once = np.unique(sig, return_index=True)
                mine = np.isin(row, once)
                uniq, count = np.unique(grams[mine], return_counts=True)
                often = count >= max(8, len(once) // 256)
                if often.any():
                    raw = np.stack([uniq[often].view(np.int64), count[often].astype(np.int64)], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(raw), pa.int64()), pa.nulls(len(raw), pa.int64()), pa.array(raw[:, 0].copy()), pa.array(raw[:, 1].copy()), pa.nulls(len(raw), pa.binary()), pa.array([b""] * len(raw), pa.binary())], names)

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig long, sig2 long, vec binary, hot binary")
    return keep(rows, "sets")


def shared_prefixes(docs: DataFrame, frequent: list, buckets: int) -> DataFrame:
    """Pairs of sets that share a prefix shingle (run null, a, b), and members of runs too long to pair up (run, a)."""
    hot = np.array([r["sig"] for r in frequent], np.int64).view(np.uint64)
    count = np.array([r["c"] for r in frequent], np.int64)
    by_hash = np.argsort(hot)
    rank = np.empty(len(hot), np.uint64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(hot), dtype=np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast((hot[by_hash], rank[by_hash]))  # FREQUENT entries
    names = ["bucket", "entries", "data"]
    schema = "bucket long, entries long, data binary"

    def packed(e: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
        by = np.argsort(bucket, kind="stable")
        bucket, raw = bucket[by], e[by].tobytes()
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(cut, len(bucket))
        at = (_ENTRY.itemsize * ends).tolist()
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(np.diff(ends)), pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = shared.value
        for batch in batches:
            for _, buf, offsets in _chunked_text(batch):
                rows = len(offsets) - 1
                grams, row = shingle_sets(buf, offsets)
                sig, _ = _signature(grams, row, rows)
                n = np.bincount(row, minlength=rows)
                order = grams >> np.uint64(1)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
                    is_hot = hot[at] == grams
                    order = np.where(is_hot, np.uint64(1 << 63) + rank[at], order)
                by_order = np.argsort(order)
                by_order = by_order[np.argsort(row[by_order].astype(np.uint16 if rows <= 65536 else np.int64), kind="stable")]
                place = np.arange(len(grams)) - np.searchsorted(row, row)
                length = n - (NUM * n + DEN - 1) // DEN + 1
                _, once = np.unique(sig, return_index=True)
                take = by_order[(place < length[row]) & np.isin(row, once)]
                e = np.empty(len(take), _ENTRY)
                e["key"], e["sig"], e["n"], e["place"] = grams[take], sig[row[take]], n[row[take]], place[(place < length[row]) & np.isin(row, once)]
                yield packed(e, (e["key"] % np.uint64(buckets)).astype(np.int64))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                e = np.frombuffer(data.as_buffer(), _ENTRY)
                yield pa.RecordBatch.from_arrays([pa.array(e["key"].astype(np.int64)), pa.array(e["sig"].copy()), pa.array(e["n"].astype(np.int64)), pa.array(e["place"].astype(np.int64))], ["key", "sig", "n", "place"])

    def repack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = np.empty(batch.num_rows, _ENTRY)
            for c in _ENTRY.names:
                e[c] = batch.column(c).to_numpy().astype(_ENTRY[c])
            yield packed(e, batch.column("bucket").to_numpy())

    def runs(table: pa.Table, dealt: bool = False) -> pa.Table:
        e = np.frombuffer(b"".join(table.column("data").to_pylist()), _ENTRY)
        e = e[np.lexsort((e["sig"], e["key"]))]
        new = np.ones(len(e), bool)
        new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["sig"][1:] != e["sig"][:-1])
        e = e[new]
        first = np.flatnonzero(np.append(True, e["key"][1:] != e["key"][:-1])) if len(e) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(e)))
        sig, n, place = e["sig"], e["n"].astype(np.int64), e["place"].astype(np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for k in range(2, SMALL_RUN + 1):
            head = first[size == k]
            for i in range(k):
                for j in range(i + 1, k):
                    a, b = head + i, head + j
                    # If this is the first shingle the two share, they share no more than what follows it.
                    ok = may_link(np.minimum(n[a] - place[a], n[b] - place[b]), n[a], n[b])
                    pairs.append(np.stack([sig[a[ok]], sig[b[ok]]], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        # Long runs with the same members are the same work: name a run by its members, and keep one in this bucket.
        total = np.add.reduceat(B.mix(sig.view(np.uint64)), first) if len(first) else np.zeros(0, np.uint64)
        _, one = np.unique(total, return_index=True)
        chosen = np.zeros(len(first), bool)
        chosen[one] = True
        chosen &= size > SMALL_RUN
        member = np.repeat(chosen, size)
        long, own = np.repeat(total, size)[member], sig[member]
        # A run of several parts: each pair of parts is a run of its own.  (Those dealt below have two parts at most.)
        parts = np.repeat(-(-size // (2 * PART)) * 2 - 1 if not dealt else np.ones(len(size), np.int64), size)[member]
        if (parts > 1).any():
            base = np.repeat(np.arange(len(own)), parts)
            j = np.arange(len(base)) - np.repeat(np.cumsum(parts) - parts, parts)
            i = (B.mix(own.view(np.uint64))[base] % parts[base].astype(np.uint64)).astype(np.int64)
            pair = (np.minimum(i, j) << 32 | np.maximum(i, j)).astype(np.uint64)
            long, own = np.where(parts[base] > 1, B.mix(long[base] ^ B.mix(pair + np.uint64(1))), long[base]), own[base]
        none, long = np.zeros(len(pairs), np.int64), long.view(np.int64)
        empty = np.arange(len(pairs) + len(long)) < len(pairs)
        return pa.table({"run": pa.array(np.append(none, long), mask=empty), "a": np.append(pairs[:, 0], own), "b": pa.array(np.append(pairs[:, 1], np.zeros(len(long), np.int64)), mask=~empty)})

    found = "run long, a long, b long"
    sent = keep(docs.select("doc_id", "text").mapInArrow(send, schema), "prefixes")
    loads = keep(sent.groupBy("bucket").agg(F.sum("entries").alias("load")), "loads")
    total = loads.agg(F.sum("load")).first()[0] or 0
    heavy = loads.where(F.col("load") > max(HEAVY * total // buckets, 4 * PART)).select(F.col("bucket").alias("__heavy"))
    light = sent.join(heavy, F.col("bucket") == F.col("__heavy"), "left_anti").groupBy("bucket").applyInArrow(lambda t: runs(t), found)
    if heavy.isEmpty():
        return keep(light, "runs")
    # Heavy buckets: every frequent shingle is counted, and its sets are dealt in pairs of parts.
    rows = keep(sent.join(heavy, F.col("bucket") == F.col("__heavy"), "left_semi").mapInArrow(unpack, "key long, sig long, n long, place long"), "heavy")
    often = keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > PART).select(F.col("key").alias("__key"), F.ceil(F.col("c") / PART).cast("int").alias("parts")), "often")
    n_often = often.count()
    dealt = rows.join(F.broadcast(often) if n_often <= FREQUENT else often, F.col("key") == F.col("__key"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    i, j = F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"), F.col("j")
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("key", F.when(F.col("parts") > 1, F.xxhash64("key", F.least(i, j), F.greatest(i, j))).otherwise(F.col("key")))
    groups = max(64, rows.count() // 500_000 + n_often)
    dealt = dealt.select(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("bucket"), "key", "sig", "n", "place").mapInArrow(repack, schema)
    return keep(light.unionByName(dealt.groupBy("bucket").applyInArrow(lambda t: runs(t, True), found)), "runs")


def _stack(vectors: list[bytes], groups: int) -> np.ndarray:
    """Vectors as rows of ``groups`` counts each; a count that is full has no upper limit."""
    out = np.empty((len(vectors), groups), np.int32)
    size = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for k in np.unique(size).tolist():
        which = np.flatnonzero(size == k)
        v = np.frombuffer(b"".join(vectors[i] for i in which), np.uint8).reshape(len(which), k).astype(np.int32)
        v[v == _FULL] = 1 << 20
        out[which] = v.reshape(len(which), k // groups, groups).sum(axis=1)
    return out


def overlap_bounds(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sums of coordinate minima of pairs of vectors, each pair folded to the smaller size."""
    least = np.fromiter((min(len(x), len(y)) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    out = np.zeros(len(a), np.int64)
    for k in np.unique(least).tolist():
        which = np.flatnonzero(least == k)
        step = max(1, (1 << 22) // k)
        for at in range(0, len(which), step):
            part = which[at : at + step]
            out[part] = np.minimum(_stack([a[i] for i in part], k), _stack([b[i] for i in part], k)).sum(axis=1)
    return out


def may_link(bound: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether an overlap of ``bound`` would make sets of a and b shingles link."""
    return (NUM + DEN) * np.minimum(bound, np.minimum(a, b)) >= NUM * (a + b)


class CountTree:
    """An R-tree over count vectors, bulk-loaded; a node keeps the largest count of each group and its range of sizes."""

    FAN = 16

    def __init__(self, n: np.ndarray, vec: np.ndarray):
        lead = vec.argmax(axis=1)
        self.order = np.lexsort((lead, n))
        self.n, self.vec = n[self.order], vec[self.order]
        self.levels = []
        high, low_n, high_n = self.vec, self.n, self.n
        while len(high) > self.FAN:
            at = np.arange(0, len(high), self.FAN)
            high, low_n, high_n = np.maximum.reduceat(high, at), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at)
            self.levels.append((high, low_n, high_n))
        self.alive = np.ones(len(n), bool)

    def search(self, n: int, vec: np.ndarray) -> np.ndarray:
        """Places (in ``order``) of live entries whose bound allows a link with the query."""
        nodes = None
        for high, low_n, high_n in reversed(self.levels):
            nodes = np.arange(len(high)) if nodes is None else self._children(nodes, len(high))
            fits = (DEN * low_n[nodes] * NUM <= DEN * DEN * n) & (DEN * high_n[nodes] >= NUM * n)
            nodes = nodes[fits]
            bound = np.minimum(high[nodes], vec).sum(axis=1)
            nodes = nodes[(NUM + DEN) * bound >= NUM * (n + low_n[nodes])]
        at = np.arange(len(self.n)) if nodes is None else self._children(nodes, len(self.n))
        at = at[self.alive[at]]
        return at[may_link(np.minimum(self.vec[at], vec).sum(axis=1), self.n[at], n)]

    def _children(self, nodes: np.ndarray, size: int) -> np.ndarray:
        out = (nodes[:, None] * self.FAN + np.arange(self.FAN)).reshape(-1)
        return out[out < size]


def forest(n: np.ndarray, vectors: list[bytes]) -> list[tuple[int, int]]:
    """Edges that span the graph of pairs whose bound allows a link: a search over folded vectors, then the whole ones."""
    tree, edges = CountTree(n, _stack(vectors, GROUPS)), []
    vectors = [vectors[i] for i in tree.order]
    for seed in range(len(n)):
        if not tree.alive[seed]:
            continue
        tree.alive[seed] = False
        queue = [seed]
        while queue:
            u = queue.pop()
            found = tree.search(int(tree.n[u]), tree.vec[u])
            found = found[may_link(overlap_bounds([vectors[u]] * len(found), [vectors[i] for i in found]), tree.n[found], tree.n[u])]
            tree.alive[found] = False
            for v in found.tolist():
                edges.append((int(tree.order[u]), int(tree.order[v])))
                queue.append(v)
    return edges


def surviving_pairs(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) node ids: survivors of the bound, pairs of short runs and a forest of each long one."""
    pairs = runs.where("run is null").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    left = nodes.select(F.col("sig").alias("x"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
    right = nodes.select(F.col("sig").alias("y"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ok = may_link(overlap_bounds(batch.column("va").to_pylist(), batch.column("vb").to_pylist()), na, nb)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])

    short = pairs.join(left, "x").join(right, "y").select("a", "b", "na", "nb", "va", "vb").mapInArrow(bounded, "a long, b long")

    def spanned(table: pa.Table) -> pa.Table:
        run, node, n, vec = (table.column(c) for c in ("run", "node", "n", "vec"))
        run, node, n, vec = run.to_numpy(), node.to_numpy(), n.to_numpy(), vec.to_pylist()
        order = np.lexsort((node, run))
        cut = np.append(np.flatnonzero(np.append(True, np.diff(run[order]) != 0)), len(order))
        a, b = [], []
        for s, e in zip(cut, cut[1:], strict=False):
            own = order[s:e]
            own = own[np.append(True, np.diff(node[own]) != 0)]
            for x, y in forest(n[own], [vec[i] for i in own]):
                a.append(node[own[x]])
                b.append(node[own[y]])
        return pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    long = runs.where("run is not null").select("run", F.col("a").alias("sig")).distinct().join(nodes, "sig").select("run", "node", "n", "vec")
    groups = max(512, runs.where("run is not null").count() // 20_000)
    long = long.groupBy(F.pmod(F.xxhash64("run"), F.lit(groups)).alias("g")).applyInArrow(spanned, "a long, b long")
    return keep(short.unionByName(long).distinct(), "survivors")


def links_in_block(grams: np.ndarray, row: np.ndarray, rows: int, copies: np.ndarray, second: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that span the components of these sets, and for each set the copies of all sets linked with it.

    With ``second`` (a mark for each set) only pairs of a marked and an unmarked set count.
    """
    size = np.bincount(row, minlength=rows)
    _, item = np.unique(grams, return_inverse=True)
    own = np.searchsorted(row, np.arange(rows + 1))
    component, links, linked = np.arange(rows), [], np.zeros(rows, np.int64)
    indexed = np.arange(len(row)) if second is None else np.flatnonzero(second[row])
    by = indexed[np.argsort(item[indexed], kind="stable")]  # ascending rows inside an item
    posting, edge = row[by], np.searchsorted(item[by], np.arange(item.max(initial=-1) + 2))
    start, end = edge[:-1].copy(), edge[1:]
    for u in range(rows) if second is None else np.flatnonzero(~second).tolist():
        mine = item[own[u] : own[u + 1]]
        if second is None:
            start[mine] += 1  # u itself: what is left follows u
        s, length = start[mine], end[mine] - start[mine]
        total = int(length.sum())
        if not total:
            continue
        at = np.repeat(s - (np.cumsum(length) - length), length) + np.arange(total)
        overlap = np.bincount(posting[at], minlength=rows)
        near = np.flatnonzero(((NUM + DEN) * overlap >= NUM * (size + size[u])) & (overlap > 0))
        linked[u] += copies[near].sum()
        linked[near] += copies[u]
        new = near[component[near] != component[u]]
        if len(new):
            old, first = np.unique(component[new], return_index=True)
            links += [(u, v) for v in new[first].tolist()]
            component[np.isin(component, old)] = component[u]
    return links, linked


def _texts_of(docs: DataFrame, wanted: DataFrame, wanted_rows: int) -> DataFrame:
    """``wanted`` (id, ...) with the texts; a bounded Bloom filter keeps other texts out of the shuffle."""
    maps, bits = member_filter(wanted.select(F.col("id").alias("print")), wanted_rows)
    likely = with_maybe(docs.select("doc_id", "text").withColumn("print", F.col("doc_id")), maps, bits).where("maybe").select("doc_id", "text")
    return wanted.join(likely, F.col("id") == F.col("doc_id")).drop("id")


def verified_links(docs: DataFrame, survivors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of links that span the components (a, b), and of linked documents of a set (a, sig, sig2, linked; b null)."""
    blocks = keep(connected_components(survivors), "blocks")
    total = blocks.count()
    sizes = blocks.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    big = keep(sizes.where(F.col("size") > BLOCK_PART).select(F.col("component").alias("__c"), F.ceil(F.col("size") / BLOCK_PART).cast("int").alias("parts")), "big")
    # A block beyond BLOCK_PART documents is split; there are at most total / BLOCK_PART of them.
    parts = blocks.join(F.broadcast(big) if total < BLOCK_PART * 100_000 else big, F.col("component") == F.col("__c"), "left").select("id", "component", F.coalesce("parts", F.lit(1)).alias("parts"))
    i = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    parts = parts.withColumn("own", i).withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    parts = parts.select("id", "component", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (F.col("own") == F.greatest("i", "j")).alias("second"))
    # An id that names several texts stands for each of their sets.
    parts = parts.join(nodes.select(F.col("node").alias("__node"), "sig", "sig2", "copies"), F.col("id") == F.col("__node")).drop("__node")
    groups = max(64, total // 2000)

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("i", "ascending"), ("j", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        keys = np.stack([table.column(c).to_numpy() for c in ("component", "i", "j")], axis=1)
        cut = np.append(np.flatnonzero(np.append(True, (np.diff(keys, axis=0) != 0).any(axis=1))), len(keys)) if len(keys) else np.zeros(1, int)
        ids, sig, sig2, copies = (table.column(c).to_numpy() for c in ("doc_id", "sig", "sig2", "copies"))
        second = table.column("second").to_numpy(zero_copy_only=False)
        a, b, of, sums = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(cut.tolist(), cut.tolist()[1:], strict=False):
            sets, done, mine = [], 0, []
            for part, buf, offsets in _chunked_text(pa.RecordBatch.from_arrays([table.column("text").slice(s, e - s).combine_chunks()], ["text"])):
                grams, row = shingle_sets(buf, offsets)
                sets.append((grams, row + done))
                mine.append(np.stack(_signature(grams, row, part.num_rows), axis=1))
                done += part.num_rows
            grams, row = map(np.concatenate, zip(*sets, strict=True))
            mine = np.concatenate(mine)
            # Rows whose text has the set they stand for, each set once.
            good = np.flatnonzero((mine[:, 0] == sig[s:e]) & (mine[:, 1] == sig2[s:e]))
            good = np.sort(good[np.unique(np.column_stack([ids[s:e][good], mine[good]]), axis=0, return_index=True)[1]])
            place = np.full(e - s, -1)
            place[good] = np.arange(len(good))
            stays = place[row] >= 0
            good += s
            links, linked = links_in_block(grams[stays], place[row[stays]], len(good), copies[good], second[good] if keys[s, 1] != keys[s, 2] else None)
            a += [ids[good[x]] for x, _ in links]
            b += [ids[good[y]] for _, y in links]
            of.append(good[linked > 0])
            sums.append(linked[linked > 0])
        of, sums = np.concatenate(of), np.concatenate(sums)
        link = np.arange(len(a) + len(of)) < len(a)
        after = lambda x: pa.array(np.append(np.zeros(len(a), np.int64), x), mask=link)
        return pa.table({"a": np.append(np.array(a, np.int64), ids[of]), "b": pa.array(np.append(np.array(b, np.int64), np.zeros(len(of), np.int64)), mask=~link), "sig": after(sig[of]), "sig2": after(sig2[of]), "linked": after(sums)})

    texts = _texts_of(docs, parts, total).select("doc_id", "text", "component", "i", "j", "second", "sig", "sig2", "copies")
    found = texts.groupBy(F.pmod(F.xxhash64("component", "i", "j"), F.lit(groups)).alias("g")).applyInArrow(verify, "a long, b long, sig long, sig2 long, linked long")
    return keep(found, "links")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row."""
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    described = describe(docs)
    sets = described.where("hot is null").select("doc_id", "n", "sig", "sig2", "vec")
    frequent = described.where("hot is not null").groupBy("sig").agg(F.sum("sig2").alias("c")).orderBy(F.desc("c"), "sig").limit(FREQUENT).collect()
    total = sets.agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("rows")).first()
    filled = sets.where("n > 0 and doc_id is not null")
    # One node per different set, named by its smallest document.
    nodes = keep(filled.groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")), "nodes")
    runs = shared_prefixes(docs.where("doc_id is not null"), frequent, max(512, int((total["shingles"] or 0) // 4_000_000)))
    links = verified_links(docs, surviving_pairs(runs, nodes.select("sig", "node", "n", "vec")), nodes)
    labels = keep(connected_components(links.where("b is not null").select("a", "b")), "components")
    linked = links.where("b is null").groupBy("a", "sig", "sig2").agg(F.sum("linked").alias("linked")).withColumnRenamed("a", "node")
    named = nodes.join(linked, ["node", "sig", "sig2"], "left").join(labels, F.col("node") == F.col("id"), "left")
    named = named.select("sig", "sig2", "n", "copies", F.coalesce("component", "node").alias("component_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    named = keep(named, "named")
    out = attach(filled.select("doc_id", "sig", "sig2", "n"), named, ["sig", "sig2", "n"], "copies", total["rows"] or 0).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows whose id names their component: one document of each group, with all columns."""
    found = near_duplicates(docs, text, key)
    gone = keep(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "near")
    return without_ids(docs, gone, key)
