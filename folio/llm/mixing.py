"""Mixing sources to target weights by a Pfair schedule.

The rows of a source are numbered in a pseudo-random order and cut into blocks of
``block`` rows.  A source with weight a/A gets block k (from 0) released at slot
floor(k*A/a) and due at slot ceil((k+1)*A/a); one slot holds one block, and at each
slot the released block with the earliest deadline goes next, which meets every
deadline.  So until a source runs out, after any number of slots it has had its
weight's share within less than one block.  A source that has run out leaves its
slots empty; no row is dropped or repeated.

The weights are those given, as integers of ``SCALE``; releases and deadlines are
exact integers (a weight below n / 2**61 of a source of n rows counts as that).  With a ``period`` they are rounded to shares of at least 1 of that many
slots instead.  Every source has its own weight.  The driver orders the blocks, from
one number for each source, and writes ``SLOTS_AT_ONCE`` of them at a time; blocks have
``BLOCK_ROWS`` rows, or as many more as keep them at ``MAX_BLOCKS``, so this work has a
bound.  Rows are only touched by DataFrame operations, and texts only hashed.

Defined cases: a null source is a source of its own; a source that ``weights`` do not
name, or give nothing, comes after the last slot of the others (equal weights); rows
without or with repeated ``doc_id`` are ordered by hashes of id and text, and rows equal
in both stand in any order; an empty table gives no rows; other columns pass through,
but for those whose names begin with ``mix_``, which are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.session import fresh_path, keep

#: The sum of all weights as integers.
SCALE = 1 << 52
#: A source of n rows has a share of at least n / LEAST_SHARE (a weight of n / 2**61), so that its last position is a 64-bit number.
LEAST_SHARE = 512
#: Rows of a block, and blocks (besides one for each source) that the driver orders at most.
BLOCK_ROWS, MAX_BLOCKS = 64, 1 << 22
#: Rows numbered by one task, about.
RANGE_ROWS = 1024
#: Blocks the driver holds before it writes them.
SLOTS_AT_ONCE = 1 << 18


def shares(weights: np.ndarray, period: int | None = None) -> list[int]:
    """Integer shares in proportion to ``weights`` (all above 0); with a period, of at least 1 and of that sum (largest remainders)."""
    part = weights / weights.sum()
    if period is None:
        base = [int(x * SCALE) for x in part.tolist()]
        cut = [i for i in np.argsort([k - x * SCALE for k, x in zip(base, part.tolist(), strict=True)], kind="stable").tolist() if base[i] != part[i] * SCALE] or [0]
        each, more = divmod(SCALE - sum(base), len(cut))
        for at, i in enumerate(cut):
            base[i] += each + (at < more)
        return [max(1, x) for x in base]
    if len(part) > period:
        raise ValueError(f"{len(part)} sources do not fit a period of {period} slots")
    exact = part * (period - len(part))
    base = np.floor(exact).astype(np.int64) + 1
    base[np.argsort(base - 1 - exact, kind="stable")[: period - base.sum()]] += 1
    return base.tolist()


def schedule(share: list[int], blocks: list[int], begin: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, release, deadline, slot) of every block of every source, by slot from ``begin``."""
    whole, had = sum(share), [0] * len(share)
    waiting, ready, t = [(0, i) for i, n in enumerate(blocks) if n], [], 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            released, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(had[i] + 1) * whole // share[i]), i, released))
        due, i, released = heapq.heappop(ready)
        yield i, had[i], begin + released, begin + due, begin + t
        t += 1
        had[i] += 1
        if had[i] < blocks[i]:
            heapq.heappush(waiting, (had[i] * whole // share[i], i))


def _planned(streams: DataFrame, block: int, period: int | None) -> DataFrame:
    """(id, share, weight, mix_block, release, deadline, slot): where the blocks of ``streams`` (id, n, w) go."""
    spark = streams.sparkSession
    table = streams.select("id", "n", "w").toArrow().sort_by("id")  # three numbers for each source
    ids, n, w = (table.column(c).to_numpy() for c in ("id", "n", "w"))
    blocks, path, begin = -(-n // block), fresh_path(spark, "schedule"), 0
    kind = pa.schema([(c, pa.float64() if c == "weight" else pa.int64()) for c in ("id", "share", "weight", "mix_block", "release", "deadline", "slot")])

    def write(rows: list[tuple]) -> None:
        columns = list(zip(*rows, strict=True)) or [()] * len(kind)
        spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)).write.mode("append").parquet(path)

    write([])
    for which in (np.flatnonzero(w > 0), np.flatnonzero(~(w > 0))):
        if not len(which):
            continue
        named = bool(w[which[0]] > 0)
        share = shares(w[which] if named else np.ones(len(which)), period if named else None)
        if period is None:
            share = [max(s, -(-int(k) * block // LEAST_SHARE)) for s, k in zip(share, blocks[which].tolist(), strict=True)]
        whole, held = sum(share), []
        for i, k, release, due, slot in schedule(share, blocks[which].tolist(), begin):
            held.append((int(ids[which[i]]), share[i] if named else 0, share[i] / whole if named else 0.0, k, release, due, slot))
            if len(held) == SLOTS_AT_ONCE:
                write(held)
                held = []
        if held:
            write(held)
        begin = slot + 1
    return spark.read.parquet(path)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", key: str = "doc_id", text: str = "text", block: int | None = None, period: int | None = None, alpha: float = 0.5) -> DataFrame:
    """``docs`` plus mix_stream, mix_share, mix_weight, mix_block, mix_release, mix_deadline, mix_slot and mix_position (unique, in mixed order).

    Without ``weights`` a source of n rows weighs n**alpha.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    total = docs.count()
    block = block or max(BLOCK_ROWS, -(-total // MAX_BLOCKS))
    own = "mix__"  # no column of ``docs`` begins like this

    # Number the rows of each source without gathering a source in one task: by ranges of a hash.
    ranges = max(1, -(-total // RANGE_ROWS))
    hashes = [F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), F.lit(seed)) for seed in (7, 11)]
    rows = docs.withColumn("mix_stream", F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit("null"))).withColumn(f"{own}hash", hashes[0]).withColumn(f"{own}next", hashes[1])
    rows = rows.withColumn(f"{own}range", F.floor((F.shiftright(f"{own}hash", 33) + F.lit(1 << 30)) * F.lit(ranges) / F.lit(1 << 31)).cast("int"))
    sizes = keep(rows.groupBy("mix_stream", F.col(f"{own}range").alias("range")).count(), "ranges")

    streams = sizes.groupBy("mix_stream").agg(F.sum("count").alias("n"))
    if weights is None:
        streams = streams.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = spark.createDataFrame([("null" if k is None else f"={k}", float(v)) for k, v in weights.items()], "mix_stream string, w double")
        streams = streams.join(given, "mix_stream", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    streams = keep(streams.orderBy(F.desc("n"), "mix_stream").withColumn("id", F.monotonically_increasing_id()), "streams")
    plan = _planned(streams, block, period)

    # A range of a source holds consecutive blocks: their slots go with the range, so that no text shuffles again.
    before = Window.partitionBy("mix_stream").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).join(streams.select("mix_stream", "id"), "mix_stream")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("count") - 1) / block)
    planned = starts.withColumn("mix_block", F.explode(F.sequence(first, last))).join(plan, ["id", "mix_block"])
    slots = F.array_sort(F.collect_list(F.struct("mix_block", "release", "deadline", "slot")))
    starts = planned.groupBy("mix_stream", F.col("range").alias(f"{own}range"), F.col("start").alias(f"{own}start")).agg(F.first("share").alias("mix_share"), F.first("weight").alias("mix_weight"), slots.alias(f"{own}slots"))
    starts = keep(starts, "starts")

    inner = F.row_number().over(Window.partitionBy("mix_stream", f"{own}range").orderBy(f"{own}hash", f"{own}next")) - 1
    rows = rows.withColumn(f"{own}inner", inner).join(starts, ["mix_stream", f"{own}range"]).withColumn(f"{own}rank", F.col(f"{own}start") + F.col(f"{own}inner"))
    rows = rows.withColumn("mix_block", F.floor(F.col(f"{own}rank") / block).cast("long"))
    slot = F.get(f"{own}slots", (F.col("mix_block") - F.floor(F.col(f"{own}start") / block)).cast("int"))
    return rows.withColumn(f"{own}slot", slot).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "mix_stream",
        "mix_share",
        "mix_weight",
        "mix_block",
        F.col(f"{own}slot.release").alias("mix_release"),
        F.col(f"{own}slot.deadline").alias("mix_deadline"),
        F.col(f"{own}slot.slot").alias("mix_slot"),
        (F.col(f"{own}slot.slot") * block + F.pmod(F.col(f"{own}rank"), F.lit(block))).cast("long").alias("mix_position"),
    )


def ordered(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all their columns under any name, in files in mixed order."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    packed = docs.select(own, F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text"))
    return in_order(mix(packed, weights, **options)).select("doc.*")


def in_order(mixed: DataFrame) -> DataFrame:
    """Mixed rows in files that follow one another in mixed order, without the mix_ columns."""
    mine = [c for c in mixed.columns if not c.startswith("mix_")]
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*[F.col(f"`{c}`") for c in mine])
