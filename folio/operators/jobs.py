"""Batch jobs as a state table: planning, resume, retry rounds, transitions and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators import model

DONE = ("succeeded", "skipped")
#: Errors that no retry can mend.
FINAL_ERRORS = ("must be .pdf", "not accessible")


def run_dir(path: Column, input_path: str, output_root: str, single: bool = False) -> Column:
    """Output folder of a file: its path below the input folder, or its name alone, without the extension."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    below = name if single else F.when(path.startswith(input_path.rstrip("/") + "/"), F.substr(path, F.lit(len(input_path.rstrip("/")) + 2))).otherwise(name)
    return F.concat(F.lit(output_root.rstrip("/") + "/"), F.regexp_replace(below, r"\.[^./]*$", ""))


def retryable(error: Column) -> Column:
    low = F.lower(error)
    out = error.isNotNull()
    for text in FINAL_ERRORS:
        out = out & ~F.contains(low, F.lit(text))
    return F.coalesce(out, F.lit(False))


def plan(files: DataFrame, state: DataFrame, reports: DataFrame, resume: bool = True) -> DataFrame:
    """The jobs of ``files`` (input_pdf, run_dir) given a saved ``state`` and the folders that hold a report (``run_dir``).

    A finished job whose report exists is skipped, any other saved one starts afresh;
    saved jobs without a file vanish.  Of several saved states of a file the last counts (by ``seq`` where there is one, else as they come).
    """
    state = model.last_of(state, ["input_pdf"], "seq")
    saved = state.select("input_pdf", F.col("status").alias("s"), F.col("run_dir").alias("saved_dir"), F.col("attempts").alias("a"))
    there = reports.select(F.col("run_dir").alias("r")).distinct()
    rows = files.join(saved, "input_pdf", "left")
    rows = rows.withColumn("look", F.when(F.col("s").isin(*DONE), F.col("saved_dir")).when(F.col("s").isNull(), F.col("run_dir")))
    rows = rows.join(there, F.col("look") == F.col("r"), "left")
    skip = F.lit(resume) & F.col("r").isNotNull()
    return rows.select("input_pdf", "run_dir", F.when(skip, "skipped").otherwise("pending").alias("status"), F.when(skip & F.col("s").isNotNull(), F.col("a")).otherwise(0).cast("int").alias("attempts"), (~skip).alias("retryable"))


def runnable(jobs: DataFrame, attempt: int) -> DataFrame:
    """Round 0 runs pending jobs; round n those that failed, may be retried and have n attempts."""
    if attempt == 0:
        return jobs.where("status = 'pending'")
    return jobs.where((F.col("status") == "failed") & F.col("retryable") & (F.col("attempts") == attempt))


def latest(transitions: DataFrame, keys: list[str] | None = None, order: str = "seq") -> DataFrame:
    """The last transition of every job."""
    keys = keys or ["input_pdf"]
    rest = [c for c in transitions.columns if c not in keys]
    return transitions.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*keys, "last.*")


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "succeeded", "failed", "skipped")])


def report(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "skipped", "failed")])


def effective_workers(workers: Column, pending: Column) -> Column:
    return F.when(pending == 0, 0).otherwise(F.least(F.greatest(workers, F.lit(1)), pending))


def run(jobs: DataFrame, execute: Callable[[DataFrame], DataFrame], retry_failed: int = 0, on_change: Callable[[DataFrame], object] = lambda jobs: None) -> DataFrame:
    """All rounds: ``execute`` takes runnable jobs and returns (input_pdf, error); failed ones are tried again at the end.

    ``on_change`` is given all jobs at the start, with those of a round running, and after each round.
    """
    from folio.session import keep

    jobs = jobs if "error" in jobs.columns else jobs.withColumn("error", F.lit(None).cast("string"))
    on_change(jobs)
    for attempt in range(retry_failed + 1):
        todo = runnable(jobs, attempt)
        some = not todo.isEmpty()
        now = F.col("__todo").isNotNull()
        started = jobs.join(todo.select("input_pdf", F.lit(True).alias("__todo")), "input_pdf", "left")
        if some:
            on_change(started.withColumn("status", F.when(now, "running").otherwise(F.col("status"))).withColumn("error", F.when(~now, F.col("error"))).drop("__todo"))
        got = execute(todo).select("input_pdf", F.col("error").alias("__error"), F.lit(True).alias("__ran"))
        rows = jobs.join(got, "input_pdf", "left")
        ran = F.coalesce("__ran", F.lit(False))
        rows = rows.withColumn("attempts", F.col("attempts") + ran.cast("int"))
        rows = rows.withColumn("status", F.when(~ran, F.col("status")).when(F.col("__error").isNull(), "succeeded").otherwise("failed"))
        rows = rows.withColumn("retryable", F.when(ran, retryable(F.col("__error"))).otherwise(F.col("retryable")))
        rows = rows.withColumn("error", F.when(ran, F.col("__error")).otherwise(F.col("error")))
        jobs = keep(rows.select("input_pdf", "run_dir", "status", "attempts", "retryable", "error"), "jobs")
        if some:
            on_change(jobs)
    return jobs
