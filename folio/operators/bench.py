"""Benchmark runs: specs, relative figures, the fastest run and a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T


def auto_workers(bundled: bool, cpus: int) -> int:
    """Two for the bundled recogniser, else one less than the CPUs, between 1 and 8."""
    return 2 if bundled else min(8, max(1, cpus - 1))


def parse_specs(text: str, auto: int) -> list[tuple[str, int, str]]:
    """``1,4,auto`` -> (label, workers, mode); a repeated label is an error."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        if part == "auto":
            out.append(("auto", auto, "auto"))
        elif part.isdigit() and int(part) >= 1:
            out.append((f"w{int(part)}", int(part), "manual"))
        else:
            raise ValueError(f"bad worker spec {part!r}")
    if not out:
        raise ValueError("no worker specs")
    if len({x[0] for x in out}) < len(out):
        raise ValueError("repeated worker spec")
    return out


def parse_shard_specs(text: str, workers: int | None) -> list[tuple[str, int, int | None, str]]:
    """``1,4`` -> (label, shards, workers, mode)."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        if not part.isdigit() or int(part) < 1:
            raise ValueError(f"bad shard spec {part!r}")
        mode = "auto" if workers is None else "manual"
        out.append((f"s{int(part)}-" + ("auto" if workers is None else f"w{workers}"), int(part), workers, mode))
    if not out or len({x[0] for x in out}) < len(out):
        raise ValueError("no shard specs, or a repeated one")
    return out


def relative(runs: DataFrame) -> DataFrame:
    """Speed-up and throughput against the first run; null where the baseline is not positive.  A benchmark has a handful of runs."""
    first = Window.orderBy("run_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    elapsed, rate = F.first("elapsed_seconds").over(first), F.first("pages_per_minute").over(first)
    speedup = F.when(elapsed > 0, elapsed / F.greatest(F.col("elapsed_seconds"), F.lit(1e-6)))
    return runs.withColumn("speedup", speedup).withColumn("throughput", F.when((elapsed > 0) & (rate > 0), F.col("pages_per_minute") / rate))


def fastest(runs: DataFrame) -> DataFrame:
    return runs.agg(F.min_by("label", F.struct("elapsed_seconds", "run_no")).alias("label"))


def _cell(c: Column, digits: int, suffix: str = "") -> Column:
    return F.concat(T.fixed(F.coalesce(c, F.lit(0.0)), digits), F.lit(suffix))


def table_rows(runs: DataFrame) -> DataFrame:
    """(run_no, line): one Markdown table row per run of :func:`relative`."""
    cells = [F.concat(F.lit("`"), "label", F.lit("`")), F.col("workers").cast("string"), F.col("mode"), _cell(F.col("elapsed_seconds"), 3), _cell(F.col("pages_per_minute"), 3), _cell(F.col("ocr_seconds"), 3), _cell(F.col("pdf_seconds"), 3), _cell(F.col("speedup"), 2, "x"), _cell(F.col("throughput"), 2, "x")]
    return runs.select("run_no", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


# Header and separator of the summary table.
TABLE_HEAD = "| Label | Workers | Mode | Seconds | Pages/min | OCR(s) | PDF(s) | Speedup | Throughput |\n|---|---:|---|---:|---:|---:|---:|---:|---:|\n"


# Header and separator of the shard summary's table.
SHARD_HEAD = "| Label | Shards | Workers/Shard | Mode | Seconds | Pages/min | OCR Total(s) | Slowest Shard(s) | Speedup | Throughput |\n|---|---:|---:|---|---:|---:|---:|---:|---:|---:|\n"


def shard_rows(runs: DataFrame) -> DataFrame:
    """(run_no, line): one Markdown table row per run of a shard benchmark; null figures count as 0."""
    seconds = [_cell(F.col(c), 3) for c in ("elapsed_seconds", "pages_per_minute", "ocr_seconds_total", "slowest_shard_seconds")]
    cells = [F.concat(F.lit("`"), "label", F.lit("`")), F.col("shards").cast("string"), F.coalesce("workers", F.lit(0)).cast("string"), F.col("mode"), *seconds, _cell(F.col("speedup"), 2, "x"), _cell(F.col("throughput"), 2, "x")]
    return runs.select("run_no", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def shard_markdown(runs: DataFrame, generated_at: str, input_pdf: str, profile: str, local_only: bool, workers: int, mode: str) -> DataFrame:
    """One row: the summary of a shard benchmark, its settings, its runs in order, and the fastest one (ties: the first)."""
    facts = {"Generated at": f"`{generated_at}`", "Input": f"`{input_pdf}`", "Profile": f"`{profile}`", "Local only": f"`{str(local_only).lower()}`", "Max workers per shard": f"`{workers}` ({mode})"}
    head = "# Process Shard Benchmark\n\n" + "".join(f"- {k}: {v}\n" for k, v in facts.items()) + f"\n{SHARD_HEAD}"
    lines = shard_rows(runs).agg(F.array_sort(F.collect_list(F.struct("run_no", "line"))).alias("l"))
    return lines.crossJoin(F.broadcast(fastest(runs))).select(F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n\n- Fastest run: `"), "label", F.lit("`\n")).alias("value"))


def markdown(runs: DataFrame, title: str) -> DataFrame:
    """One row: the whole summary, runs in order and the fastest one named."""
    head = f"# {title}\n\n{TABLE_HEAD}"
    lines = table_rows(runs).agg(F.array_sort(F.collect_list(F.struct("run_no", "line"))).alias("l"))
    best = fastest(runs)
    return lines.crossJoin(F.broadcast(best)).select(F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n\n- Fastest run: `"), "label", F.lit("`\n")).alias("value"))
