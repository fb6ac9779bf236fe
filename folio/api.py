"""Running documents: one run, a batch with resume and retries, an evaluation, and a self-check."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import bench, correct, evaluate, jobs, model, network, render, validate
from folio.plans import config as C
from folio.plans.recognizer import FixedRecognizer, Progress, Recognition, Recognizer
from folio.plans.run import Result, sidecar, write
from folio.session import keep
from folio.sources import documents as D
from folio.streaming.state import SavedState


class LocalOnlyViolation(RuntimeError):
    """A run that must stay on this machine did not; ``report`` says where it went."""

    def __init__(self, report: DataFrame):
        super().__init__(VIOLATION)
        self.report = report


@dataclass(frozen=True)
class Run:
    result: Result
    report: DataFrame
    local_only: DataFrame
    #: (input_pdf, error) of the files that were left out.
    errors: DataFrame
    #: The sidecars of the documents, given the folder they are saved in.
    sidecar: Callable[[str], DataFrame]


def local_only_report(spark: SparkSession, recognition: Recognition) -> DataFrame:
    """One row: samples, violations, and whether the monitor and the self-check are content."""
    samples = recognition.samples if recognition.samples is not None else spark.createDataFrame([], "pid long, endpoint string")
    return keep(network.local_only(network.violations(samples).withColumn("selfcheck_ok", F.lit(recognition.selfcheck_ok))), "local_only")


VIOLATION = "local-only violation detected during recognition"


def _offenders(files: DataFrame, seen: Recognition, watched: DataFrame) -> DataFrame:
    """(input_pdf, error) of the files whose recognition left the machine: those named by samples, or all where samples name none or the self-check failed."""
    named = seen.samples is not None and "input_pdf" in seen.samples.columns
    if not seen.selfcheck_ok or (not named and not watched.first()["monitor_ok"]):
        return files.select("input_pdf", F.lit(VIOLATION).alias("error"))
    rows = network.leaving(seen.samples) if named else files.where("false")
    return rows.select("input_pdf").distinct().select("input_pdf", F.lit(VIOLATION).alias("error"))


def run(files: DataFrame, recognizer: Recognizer, provider: correct.Provider | None = None, profile: C.Profile | None = None, config: C.Config | None = None, local_only: bool = False, allow_remote: bool = False, progress: Progress | None = None, isolate: bool = False) -> Run:
    """Recognise ``files`` (input_pdf), correct, render and report.

    The local-only report is written before anything is corrected, and a violation ends a
    local-only run there.  Primary artifacts are made again from corrected pages where the
    recognizer can; else the output is a sidecar and the report has a warning.

    Every file has a row in the report, with 0 pages if none was found.  A file that could not be
    recognised raises; with ``isolate`` such files, files of the wrong kind and those that break
    the local-only rule are rows of ``errors`` instead, and the others are done.
    """
    spark, profile = files.sparkSession, C.with_defaults(profile or C.Profile())
    C.allow_remote(config or C.Config(), profile, allow_remote)
    wrong = ~F.lower("input_pdf").endswith(".pdf")
    bad = files.where(wrong).first() if not isolate else None
    if bad is not None:
        C.check_pdf(bad["input_pdf"])
    errors = files.where(wrong).select("input_pdf", F.lit("input must be .pdf").alias("error"))
    began = time.monotonic()
    seen = recognizer.recognize(files.where(~wrong), progress=progress)
    if seen.errors is not None:
        errors = errors.unionByName(seen.errors.select("input_pdf", "error"))
    pages, blocks = keep(seen.pages, "pages"), keep(seen.blocks, "blocks")
    recognized = time.monotonic()
    watched = local_only_report(spark, seen)
    if local_only and isolate:
        errors = errors.unionByName(_offenders(files, seen, watched))
    elif local_only and not watched.first()["monitor_ok"]:
        raise LocalOnlyViolation(watched)
    errors = keep(errors.groupBy("input_pdf").agg(F.min("error").alias("error")), "errors")
    first = None if isolate else errors.first()
    if first is not None:
        raise RuntimeError(f"{first['input_pdf']}: {first['error']}")
    good = files.select("input_pdf").distinct().join(errors, "input_pdf", "left_anti")
    failed = errors.select(F.col("input_pdf").alias("source_pdf"))
    pages, blocks = pages.join(failed, "source_pdf", "left_anti"), blocks.join(failed, "source_pdf", "left_anti")
    pages, blocks = correct.run(pages, blocks, provider if profile.provider != "none" else None, profile.guard)
    pages, blocks = keep(pages, "corrected_pages"), keep(blocks, "corrected_blocks")
    mode, warnings = C.output_mode(profile.mode, seen.can_rebuild)
    timings = {"ocr_seconds": recognized - began, "postprocess_seconds": time.monotonic() - recognized} | dict(seen.timings)
    if mode == "primary_artifacts":
        again = recognizer.recognize(good, (pages, blocks), progress)
        if not again.from_corrected:
            raise RuntimeError(f"recognizer {recognizer.name} did not make its artifacts from the corrected pages")
        pages, blocks = again.pages, again.blocks
        timings |= again.timings  # a later value wins
        warnings = [*warnings, *again.warnings]
    notes = list(dict.fromkeys([*seen.warnings, *warnings]))
    elapsed = time.monotonic() - began
    applied = profile.provider != "none" and provider is not None
    changed = (F.col("text") != F.col("source_text")) | (F.col("correction.changed_blocks") > 0) | (F.col("correction.status") != "unchanged")
    counts = pages.groupBy(F.col("source_pdf").alias("input_pdf")).agg(F.count(F.lit(1)).cast("int").alias("pages"), F.count_if(changed).alias("changed_pages"))
    report = good.join(counts, "input_pdf", "left").fillna({"pages": 0, "changed_pages": 0}).select(
        F.lit(recognizer.name).alias("engine"),
        "input_pdf",
        F.lit(profile.provider).alias("profile"),
        F.lit(elapsed).alias("elapsed_seconds"),
        "pages",
        F.create_map(*[F.lit(x) for kv in timings.items() for x in kv]).alias("stage_timings"),
        F.array(*map(F.lit, notes)).cast("array<string>").alias("warnings"),
        F.lit(local_only).alias("local_only"),
        F.lit(applied).alias("postprocess_applied"),
        "changed_pages",
        F.lit(mode).alias("output_mode"),
    )
    result = Result(pages, blocks, render.page_text(pages), render.markdown(pages, blocks), model.changed_pages(pages))
    return Run(result, report, watched, errors, lambda path: sidecar(result, path, recognizer.name, profile, applied, mode, timings, notes))


def save(done: Run, path: str) -> None:
    """Tables, texts, Markdown and both reports below one folder."""
    write(done.result, path)
    D.write_json(done.report, f"{path}/run_report", indent=True)
    D.write_json(done.local_only, f"{path}/local_only_report", indent=True)
    D.write_json(done.sidecar(path), f"{path}/sidecar", indent=True)


def batch(spark: SparkSession, input_path: str, output_root: str, recognizer: Recognizer, state: DataFrame | None = None, reports: DataFrame | None = None, recursive: bool = False, resume: bool = True, workers: int = 1, retry_failed: int = 0, **options) -> tuple[DataFrame, DataFrame]:
    """(jobs, report): every file found, but those that an earlier ``state`` and its ``reports`` show as done; failed ones are tried again at the end.

    A round runs as one job over all its files; a file that fails, or breaks the local-only
    rule, fails alone.  Only what is no file's fault (a round that cannot be written, say)
    fails its whole round.  The state is saved below ``output_root`` whenever it changes, and
    taken up from there where no ``state`` is given.
    """
    C.check_run(input_path, workers, retry_failed)
    single = input_path.lower().endswith(".pdf")
    found = D.discover_files(spark, input_path, recursive)
    root = "file:" + input_path if "://" not in input_path and not input_path.startswith("file:") else input_path
    files = found.withColumn("run_dir", jobs.run_dir(F.col("input_pdf"), root, output_root, single))
    saved = SavedState(spark, f"{output_root}/state")
    if state is None:
        state = saved.load()
        if state is not None and reports is None:
            reports = state.where(F.col("status").isin(*jobs.DONE)).select("run_dir")
    state = state if state is not None else spark.createDataFrame([], "input_pdf string, run_dir string, status string, attempts int, retryable boolean")
    reports = reports if reports is not None else spark.createDataFrame([], "run_dir string")
    planned = keep(jobs.plan(files, state, reports, resume), "jobs")
    rounds = [max(saved.versions(), default=-1) + 1]

    def execute(todo: DataFrame) -> DataFrame:
        if todo.isEmpty():
            return todo.select("input_pdf", F.lit(None).cast("string").alias("error"))
        rounds[0] += 1
        try:
            done = run(todo.select("input_pdf"), recognizer, isolate=True, **options)
            save(done, f"{output_root}/round-{rounds[0] - 1}")
        except Exception as e:  # noqa: BLE001  the state table carries it
            return todo.select("input_pdf", F.lit(str(e)[:1000] or type(e).__name__).alias("error"))
        return todo.select("input_pdf").join(done.errors, "input_pdf", "left")

    done = jobs.run(planned, execute, retry_failed, saved.save)
    return done, jobs.report(done)


def evaluation(spark: SparkSession, gold_path: str, predicted_path: str, output_path: str | None = None) -> DataFrame:
    """Gold against predicted documents, as (source_pdf, summary, per_page); written as indented JSON where a path is given."""
    docs = D.explode_pages(D.read_documents(spark, predicted_path)).withColumnRenamed("pos", "page_pos")
    blocks = docs.select("source_pdf", "page", "page_pos", F.posexplode("blocks").alias("pos", "b")).select("source_pdf", "page", "page_pos", "pos", "b.text", "b.block_type")
    out = evaluate.result(evaluate.per_page(D.read_gold(spark, gold_path), evaluate.predicted(docs.select("source_pdf", "page", "page_pos", "text"), blocks)))
    if output_path:
        D.write_json(out, output_path, indent=True)
    return out


def validation(expected: DataFrame, extracted: DataFrame, output_path: str | None = None, dumps: int = 10, min_coverage: float = 1.0, min_ratio: float = 0.85) -> tuple[bool, DataFrame]:
    """Whether the extracted text layer (page, found) holds the expected pages (page, text), and the one-row report; with a path also the report and the first failing pages are written."""
    matches = keep(validate.page_matches(expected, extracted), "matches")
    report = keep(validate.rollup(matches, min_coverage, min_ratio), "validation")
    if output_path:
        D.write_json(report, f"{output_path}/report", indent=True)
        D.write_json(validate.dumps(matches, expected.join(extracted, "page", "left"), dumps, min_ratio), f"{output_path}/failing", indent=True)
    return bool(report.first()["ok"]), report


#: What a benchmark run reports.
BENCH_RUN = "run_no long, label string, workers int, mode string, elapsed_seconds double, pages_per_minute double, ocr_seconds double, pdf_seconds double"


def benchmark(spark: SparkSession, specs: list[tuple[str, int, str]], execute: Callable[[str, int, str], dict[str, float]], path: str, title: str = "Workers") -> DataFrame:
    """Runs of ``specs`` (label, workers, mode) with their speed-up; one whose report lies below ``path`` is not run again.

    ``execute`` gives pages, elapsed_seconds, ocr_seconds and pdf_seconds.  The summary is
    written as JSON and as Markdown.
    """
    done = []
    for n, (label, workers, mode) in enumerate(specs, 1):
        where = f"{path}/{label}"
        try:
            done.append(D.read_json_rows(spark, where, BENCH_RUN, indent=True).first())
            continue
        except AnalysisException:  # no report yet
            got = execute(label, workers, mode)
        rate = got["pages"] / got["elapsed_seconds"] * 60 if got["pages"] > 0 and got["elapsed_seconds"] > 0 else 0.0
        row = spark.createDataFrame([(n, label, workers, mode, got["elapsed_seconds"], rate, got["ocr_seconds"], got["pdf_seconds"])], BENCH_RUN)
        D.write_json(row, where, indent=True)
        done.append(row.first())
    runs = bench.relative(spark.createDataFrame(done, BENCH_RUN))
    D.write_json(runs, f"{path}/summary")
    bench.markdown(runs, title).write.mode("overwrite").text(f"{path}/summary_markdown")
    return runs


def selfcheck(spark: SparkSession) -> bool:
    """Whether a local-only run over one fixed page gives its text, unchanged and without warnings."""
    files = spark.createDataFrame([("check.pdf",)], "input_pdf string")
    done = run(files, FixedRecognizer(("self-check",)), local_only=True)
    return done.result.text.first()["value"] == "self-check\n" and done.report.first()["warnings"] == []
