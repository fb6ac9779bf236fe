"""Progress streams: parsing, snapshots, windowed counts, milestones, and running a stream over what is there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.operators import order
from folio.session import fresh_path
from folio.sources.documents import parse_progress


def progress_events(spark: SparkSession, path: str, prefix: str = "PROGRESS ") -> DataFrame:
    """A stream of (value, event) from text files as they appear."""
    return parse_progress(spark.readStream.text(path), prefix)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream, with its declared schema."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def snapshot(events: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Per key: events so far and the last of them.  In update mode each batch gives the keys it touched."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.max_by(F.struct(*rest), by).alias("last"))


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts with a watermark: an extension, the data model has no event time of its own.

    In append mode a window comes out, and its state goes, once the watermark has passed its end.
    """
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote.

    The sink and its checkpoint lie in the shared folder.  In ``complete`` and
    ``update`` mode every batch is written under its number, so a batch that is
    repeated after a failure replaces itself.
    """
    spark = stream.sparkSession
    path, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(path) if mode == "append" else spark.read.parquet(path)
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        out = out.where(F.col("batch") == last).drop("batch")
    return out


#: What a live renderer of a run looks at, and phases that a sparse one always prints.
SIGNATURE = ("phase", "stage", "completed_pages", "total_pages")
ALWAYS = ("document_started", "document_done", "stage_started", "stage_done")
#: The same for a batch.
BATCH_SIGNATURE = ("phase", "completed", "succeeded", "failed", "skipped", "running", "total", "input_pdf", "completed_pages", "total_pages", "stage")
BATCH_ALWAYS = ("start", "job_started", "job_done", "done")
_TEXTS = ("phase", "stage", "input_pdf")


def _milestone(done: int, total: int) -> int:
    return done // max(1, total // 20) if done > 0 and total > 0 else 0


def _crossed(done: int, total: int, before: int) -> bool:
    return done > 0 and (0 < total <= done or (done == 1 and before < 1) or _milestone(done, total) != _milestone(before, total))


def _run_prints(e, last, live: bool, heartbeat: float) -> bool:
    """Whether event ``e`` of a run is printed; ``last`` is the event printed before, or None."""
    paged = e.total_pages > 0
    if paged and e.phase == "page_started":
        return False
    if last is None:
        return True
    if live:
        return any(getattr(e, c) != last[c] for c in SIGNATURE)
    if e.stage != last["stage"]:
        return True
    if paged and (e.phase in ALWAYS or e.completed_pages == 1):
        return True
    if paged and e.completed_pages > last["completed_pages"] and _crossed(e.completed_pages, e.total_pages, last["completed_pages"]):
        return True
    return e.at - last["at"] >= heartbeat


def _batch_prints(e, last, live: bool, heartbeat: float) -> bool:
    """The same for a snapshot of a batch."""
    if last is None:
        return True
    if live:
        return any(getattr(e, c) != last[c] for c in BATCH_SIGNATURE)
    if e.phase in BATCH_ALWAYS or e.stage != last["stage"]:
        return True
    if any(getattr(e, d) > last[d] and _crossed(getattr(e, d), getattr(e, t), last[d]) for d, t in (("completed", "total"), ("completed_pages", "total_pages"))):
        return True
    return e.at - last["at"] >= heartbeat


def _folded(events: DataFrame, key: str, columns: tuple[str, ...], prints: Callable, live: bool, heartbeat: float) -> DataFrame:
    """(key, seq, at, phase, stage) of the events that are printed.  What is printed depends on what was printed last, so this is a fold with state: by state store in a stream, by sorted partitions, batch by batch, in a table."""
    schema = f"{key} string, seq long, at double, phase string, stage string"
    names = [key, "seq", "at", "phase", "stage"]
    kept = [*columns, "at"]

    def fold(pdf: pd.DataFrame, last: dict | None) -> tuple[list[tuple], dict | None]:
        rows = []
        for e in pdf.itertuples(index=False):
            if prints(e, last, live, heartbeat):
                last = {c: getattr(e, c) for c in kept}
                rows.append((getattr(e, key), e.seq, e.at, e.phase, e.stage))
        return rows, last

    if events.isStreaming:
        from pyspark.sql.streaming.state import GroupStateTimeout

        def stateful(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
            last = dict(zip(kept, state.get, strict=True)) if state.exists else None
            for batch in batches:
                rows, last = fold(batch.sort_values("seq"), last)
                yield pd.DataFrame(rows, columns=names)
            if last is not None:
                state.update(tuple(last[c] if isinstance(last[c], str) else float(last[c]) if c == "at" else int(last[c]) for c in kept))

        saved = ", ".join(f"{c} {'string' if c in _TEXTS else 'double' if c == 'at' else 'long'}" for c in kept)
        return events.groupBy(key).applyInPandasWithState(stateful, schema, saved, "append", GroupStateTimeout.NoTimeout)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, last = None, None
        for batch in batches:
            rows = []
            for name, part in batch.groupby(key, sort=False):
                got, last = fold(part, last if name == run else None)
                run = name
                rows += got
            yield pd.DataFrame(rows, columns=names)

    return events.select(key, "seq", "at", *columns).repartition(key).sortWithinPartitions(key, "seq").mapInPandas(whole, schema)


def rendered(events: DataFrame, live: bool = False, heartbeat_seconds: float = 5.0) -> DataFrame:
    """The events (run, seq, at, phase, stage, completed_pages, total_pages) that a progress renderer prints.

    A live one rewrites its line on any change of ``SIGNATURE``; the page at hand is not part of
    it.  Otherwise lines are sparse: a new stage, the start and end of documents and
    stages, the first page, milestones of a twentieth, and a heartbeat.
    """
    return _folded(events, "run", SIGNATURE, _run_prints, live, heartbeat_seconds)


def rendered_batch(snapshots: DataFrame, live: bool = False, heartbeat_seconds: float = 5.0) -> DataFrame:
    """The snapshots (batch, seq, at and ``BATCH_SIGNATURE``) that a batch renderer prints.

    A live one prints any change of ``BATCH_SIGNATURE``; a sparse one the start and end of the batch
    and of its jobs, a new stage, milestones of jobs and of pages, and a heartbeat.
    """
    return _folded(snapshots, "batch", BATCH_SIGNATURE, _batch_prints, live, heartbeat_seconds)


#: The statuses that a snapshot counts.
STATUSES = ("pending", "running", "succeeded", "failed", "skipped")


def batch_snapshots(transitions: DataFrame) -> DataFrame:
    """Transitions (batch, seq, input_pdf, status and any more) with the counts of their batch after each: total, completed and ``STATUSES``.

    A transition changes two counts, the status it leaves by -1 and the one it enters by +1;
    the counts are running totals of these changes, by ranges (``order.running``), so a batch of any
    size is counted by many tasks.  ``seq`` is unique in a batch.
    """
    before = F.lag("status").over(Window.partitionBy("batch", "input_pdf").orderBy("seq"))
    rows = transitions.withColumn("__was", before)
    change = lambda s: (F.col("status") == s).cast("long") - F.coalesce((F.col("__was") == s).cast("long"), F.lit(0))
    out = order.running(rows, ["batch"], ["seq"], total=F.col("__was").isNull().cast("long"), **{s: change(s) for s in STATUSES})
    return out.withColumn("completed", F.col("succeeded") + F.col("failed") + F.col("skipped")).drop("__was")


def job_states(transitions: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Latest state of every job from a stream of transitions, handed to ``sink`` batch by batch."""
    latest = snapshot(transitions, ["input_pdf"], "seq")
    return latest.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
