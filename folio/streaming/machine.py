"""Jobs as state machines on a stream of status changes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folio.streaming.progress import drain

#: From a status (empty: none yet) to the statuses that may follow.  A batch that is taken up again sets any job back to pending.
TRANSITIONS = {
    "": ("pending", "skipped"),
    "pending": ("running", "skipped"),
    "running": ("succeeded", "failed", "pending"),
    "failed": ("running", "pending"),
    "succeeded": ("pending", "skipped"),
    "skipped": ("pending",),
}
_OUT = "input_pdf string, seq long, from_status string, to_status string, legal boolean, attempts long"


class JobMachine(StatefulProcessor):
    """Takes a job from status to status; a change that is not allowed is reported and changes nothing.

    A failed job that may not be retried stays failed.  A running job that is silent for
    ``stalled_ms`` is reported once as ``stalled`` (0: never).
    """

    def __init__(self, stalled_ms: int = 0):
        self.stalled_ms = stalled_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts long, retryable boolean, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, retryable, last = self.job.get() if self.job.exists() else ("", 0, True, -1)
        out = []
        for e in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            legal = e.status in TRANSITIONS[status] and not (status == "failed" and e.status == "running" and not retryable)
            if legal and e.status in ("succeeded", "failed"):
                attempts += 1
            elif legal and e.status == "pending" and status != "running":  # taken up afresh
                attempts = 0
            out.append((key[0], int(e.seq), status, e.status, legal, attempts))
            if legal:
                status, retryable, last = e.status, bool(e.retryable), int(e.seq)
        if self.stalled_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if status == "running":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stalled_ms)
        self.job.update((status, attempts, retryable, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, _, last = self.job.get()
        yield pd.DataFrame({"input_pdf": [key[0]], "seq": [last], "from_status": [status], "to_status": ["stalled"], "legal": [None], "attempts": [attempts]})

    def close(self) -> None:
        pass


def job_changes(changes: DataFrame, stalled_ms: int = 0) -> DataFrame:
    """A stream of changes (input_pdf, seq, status, retryable) judged one by one: from_status, to_status, legal, and attempts after it.

    With ``stalled_ms`` it runs on the clock, and so has no end; without, it may be run over what is there.
    """
    return changes.groupBy("input_pdf").transformWithStateInPandas(JobMachine(stalled_ms), _OUT, "append", "ProcessingTime" if stalled_ms else "None")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which this kind of state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_changes(spark: SparkSession, changes: DataFrame) -> DataFrame:
    """The judged changes of all that a stream holds now."""
    with state_store(spark):
        return drain(job_changes(changes), "machine")
