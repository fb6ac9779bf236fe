"""Timings: worker sums, document profiles, concurrency, merged timing maps and shard totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("render", "recognize", "postprocess", "queue_wait")


def worker_summary(timings: DataFrame, worker: str, seconds: str) -> DataFrame:
    return timings.groupBy(F.col(worker).alias("worker")).agg(F.count(F.lit(1)).alias("pages"), F.sum(seconds).alias("busy_seconds"))


def stage_profile(timings: DataFrame, wall: Column) -> DataFrame:
    """One row: totals, means per page, the longest page and effective parallelism."""
    total = lambda s: F.sum(f"{s}_seconds")
    safe = F.greatest(wall, F.lit(1e-6))
    columns = [F.count(F.lit(1)).alias("pages"), F.coalesce(F.max("total_seconds"), F.lit(0.0)).alias("longest_page_seconds")]
    for s in (*STAGES, "total"):
        columns += [F.coalesce(total(s), F.lit(0.0)).alias(f"{s}_total_seconds"), F.coalesce(F.avg(f"{s}_seconds"), F.lit(0.0)).alias(f"{s}_average_seconds")]
    columns += [F.coalesce(total(s) / safe, F.lit(0.0)).alias(f"{s}_parallelism") for s in ("render", "recognize", "total")]
    return timings.agg(*columns)


# The keys of a profile's timing map, without their common prefix.
SECONDS = ("seconds", "render_seconds_total", "recognize_seconds_total", "postprocess_seconds_total", "queue_wait_seconds_total", "page_seconds_total")
MEANS = ("render_average_seconds", "recognize_average_seconds", "postprocess_average_seconds", "page_average_seconds", "longest_page_seconds")
WORKERS = ("render_workers", "recognize_workers", "render_queue_capacity")
PEAKS = ("max_active_pages", "max_active_render_workers", "max_active_recognize_workers", "max_queued_rendered_pages")
PARALLELISM = ("render_effective_parallelism", "recognize_effective_parallelism", "page_effective_parallelism")


def profile_map(timings: DataFrame, wall: Column, queue_capacity: int, prefix: str = "vision_ocr") -> DataFrame:
    """(key, value): the whole profile of a run, 21 entries.

    A page is rendered from its start, waits, and is recognised and cleaned; the most of each at once
    are peaks of those spans.
    """
    p = stage_profile(timings, wall)
    p = p.crossJoin(F.broadcast(timings.agg(F.count_distinct("render_worker").alias("render_workers"), F.count_distinct("recognize_worker").alias("recognize_workers"))))
    micros = lambda c: F.floor(F.col(c) * 1e6).cast("long")
    start = F.unix_micros("started_at")
    rendered, taken = start + micros("render_seconds"), start + micros("render_seconds") + micros("queue_wait_seconds")
    done = taken + micros("recognize_seconds") + micros("postprocess_seconds")
    spans = {"max_active_pages": (start, done), "max_active_render_workers": (start, rendered), "max_active_recognize_workers": (taken, done), "max_queued_rendered_pages": (rendered, taken)}
    for name, (a, b) in spans.items():
        span = timings.select(F.timestamp_micros(a).alias("started_at"), F.timestamp_micros(b).alias("ended_at"))
        p = p.crossJoin(F.broadcast(peak_concurrency(span).select(F.coalesce("peak", F.lit(0)).alias(name))))
    own = {"seconds": wall, "render_queue_capacity": F.lit(queue_capacity), "longest_page_seconds": F.col("longest_page_seconds")}
    own |= {f"{k}_seconds_total": F.col(f"{v}_total_seconds") for k, v in {"render": "render", "recognize": "recognize", "postprocess": "postprocess", "queue_wait": "queue_wait", "page": "total"}.items()}
    own |= {f"{k}_average_seconds": F.col(f"{v}_average_seconds") for k, v in {"render": "render", "recognize": "recognize", "postprocess": "postprocess", "page": "total"}.items()}
    own |= {f"{k}_effective_parallelism": F.col(f"{v}_parallelism") for k, v in {"render": "render", "recognize": "recognize", "page": "total"}.items()}
    entries = [F.struct(F.lit(f"{prefix}_{k}").alias("key"), (own[k] if k in own else F.col(k)).cast("double").alias("value")) for k in (*SECONDS, *MEANS, *WORKERS, *PEAKS, *PARALLELISM)]
    return p.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def timing_map(profile: DataFrame, prefix: str = "stage_") -> DataFrame:
    return profile.select(F.map_from_arrays(F.array(*[F.lit(prefix + c) for c in profile.columns]), F.array(*[F.col(c).cast("double") for c in profile.columns])).alias("timings"))


def peak_concurrency(spans: DataFrame, start: str = "started_at", end: str = "ended_at", unit: str = "hour") -> DataFrame:
    """One row ``peak``: most spans open at once; one that ends when another starts is closed first.

    Steps are summed inside time buckets in parallel; only the buckets' net changes,
    one row per bucket, pass through a single window.
    """
    steps = spans.select(F.col(start).alias("at"), F.lit(1).alias("step")).unionByName(spans.select(F.col(end).alias("at"), F.lit(-1).alias("step")))
    steps = steps.groupBy("at").agg(F.sum(F.when(F.col("step") < 0, F.col("step")).otherwise(0)).alias("down"), F.sum(F.when(F.col("step") > 0, F.col("step")).otherwise(0)).alias("up"))
    steps = steps.withColumn("bucket", F.date_trunc(unit, "at"))
    net = steps.groupBy("bucket").agg(F.sum(F.col("up") + F.col("down")).alias("net"))
    carried = net.select("bucket", F.coalesce(F.sum("net").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"))
    inside = F.sum(F.col("up") + F.col("down")).over(Window.partitionBy("bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return steps.join(carried, "bucket").select((F.col("carry") + inside).alias("open")).agg(F.max("open").alias("peak"))


def queue_wait(ready: Column, started: Column) -> Column:
    return F.greatest(F.lit(0.0), F.unix_micros(started) - F.unix_micros(ready)) / 1e6


def merge_last(timings: DataFrame, order: str = "seq") -> DataFrame:
    """(run, key, value) from rows of timing maps: a later map wins."""
    rows = timings.select("run", order, F.explode("timings").alias("key", "value"))
    return rows.groupBy("run", "key").agg(F.max_by("value", order).alias("value"))


def merge_sum(timings: DataFrame) -> DataFrame:
    """(run, key, value): values of all maps added up.  Averages and ratios in them are added too, which says nothing."""
    return timings.select("run", F.explode("timings").alias("key", "value")).groupBy("run", "key").agg(F.sum("value").alias("value"))


def pages_per_minute(pages: Column, seconds: Column) -> Column:
    return F.when((pages > 0) & (seconds > 0), pages / seconds * 60).otherwise(0.0)


def shard_totals(shards: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over shards, the slowest one, and pages per minute over it; absent timings count 0."""
    at = lambda k: F.coalesce(F.try_element_at("stage_timings", F.lit(k)), F.lit(0.0))
    out = shards.groupBy(*keys).agg(
        F.sum("pages").alias("pages"),
        F.sum(at("ocr_seconds")).alias("ocr_seconds_total"),
        F.sum(at("pdf_seconds")).alias("pdf_seconds_total"),
        F.sum(at("total_seconds")).alias("provider_seconds_total"),
        F.max("elapsed_seconds").alias("slowest_shard_seconds"),
    )
    return out.withColumn("pages_per_minute", pages_per_minute(F.col("pages"), F.col("slowest_shard_seconds")))


def merge_results(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two results of a run: paths of the second win, samples and durations add, both self-checks must hold."""
    from folio.functions.text import union_strings

    b = second.select("run", *[F.col(c).alias(f"b_{c}") for c in second.columns if c != "run"])
    rows = first.join(b, "run", "left")
    return rows.select("run", F.coalesce(F.nullif("b_path", F.lit("")), "path").alias("path"), (F.col("samples") + F.coalesce("b_samples", F.lit(0))).alias("samples"), (F.col("seconds") + F.coalesce("b_seconds", F.lit(0.0))).alias("seconds"), (F.col("selfcheck_ok") & F.coalesce("b_selfcheck_ok", F.lit(True))).alias("selfcheck_ok"), union_strings(F.col("warnings"), F.col("b_warnings")).alias("warnings"))
