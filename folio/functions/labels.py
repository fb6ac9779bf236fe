"""Labels and figures of progress lines, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short names of stages; others keep their own.
STAGES = {"vision_ocr": "ocr", "serialization": "serialize", "searchable_pdf": "searchable"}


def stage_name(stage: Column) -> Column:
    out = stage
    for name, short in STAGES.items():
        out = F.when(stage == name, short).otherwise(out)
    return out


def progress_bar(done: Column, total: Column, width: int = 24) -> Column:
    width = max(8, width)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / F.when(total > 0, total).otherwise(1)))
    filled = F.when(total > 0, F.floor(share * width + 0.5)).otherwise(0).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("="), filled), F.repeat(F.lit("-"), F.lit(width) - filled), F.lit("]"))


def format_duration(seconds: Column) -> Column:
    whole = F.floor(F.greatest(F.lit(0.0), seconds.cast("double")) + 0.5).cast("long")
    hours, minutes, rest = F.floor(whole / 3600), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60))
    return F.when(hours > 0, F.format_string("%02d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%02d:%02d", minutes, rest))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, 100.0 * done / total).otherwise(0.0)


def rate(done: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, done / seconds).otherwise(0.0)


def time_left(done: Column, total: Column, seconds: Column) -> Column:
    """Duration label; dashes when there is no rate yet or nothing left."""
    per_second = rate(done, seconds)
    return F.when((per_second > 0) & (done < total), format_duration((total - done) / per_second)).otherwise("--:--")


def counts_label(ok: Column, failed: Column, running: Column, skipped: Column) -> Column:
    base = F.format_string("ok=%d fail=%d run=%d", ok, failed, running)
    return F.when(skipped > 0, F.concat(base, F.format_string(" skip=%d", skipped))).otherwise(base)


def page_label(stage: Column, name: Column, page: Column, done: Column, total: Column) -> Column:
    short = stage_name(stage)
    counted = F.format_string(" | %s %s %d/%d", short, name, done, total)
    with_page = F.when(page > 0, F.concat(counted, F.format_string(" p%d", page))).otherwise(counted)
    return F.when(F.coalesce(stage, F.lit("")) == "", "").when(total > 0, with_page).when(name != "", F.concat(F.lit(" | "), short, F.lit(" "), name)).otherwise(F.concat(F.lit(" | "), short))


def active_label(names: Column, last: Column) -> Column:
    n = F.size(names)
    few = F.concat(F.lit(" | active "), F.array_join(names, ","))
    many = F.concat(F.lit(" | active "), n.cast("string"), F.lit("("), F.array_join(F.slice(names, 1, 2), ","), F.lit(",+"), (n - 2).cast("string"), F.lit(")"))
    return F.when(n > 2, many).when(n > 0, few).when(F.coalesce(last, F.lit("")) != "", F.concat(F.lit(" | last "), last)).otherwise("")


def milestone(done: Column, total: Column) -> Column:
    step = F.greatest(F.lit(1), F.floor(total / 20))
    return F.when((done > 0) & (total > 0), F.floor(done / step)).otherwise(0).cast("long")


def crossed(done: Column, total: Column, before: Column) -> Column:
    """Whether a progress line is due: at the first page, at the last, and when a twentieth is passed."""
    return F.when(done <= 0, False).when((total > 0) & (done >= total), True).when((done == 1) & (before < 1), True).otherwise(milestone(done, total) != milestone(before, total))


def active_names(events: Column) -> Column:
    """Names of running jobs, in the order they started, from an array of (phase, name) in order; a second start of a running job changes nothing."""
    none = F.array().cast("array<string>")

    def step(active: Column, e: Column) -> Column:
        new = (e["phase"] == "job_started") & ~F.array_contains(active, e["name"])
        return F.when(new, F.concat(active, F.array(e["name"]))).when(e["phase"] == "job_done", F.array_remove(active, e["name"])).otherwise(active)

    return F.aggregate(F.filter(events, lambda e: F.coalesce(e["name"], F.lit("")) != ""), none, step)


def credential_kind(kind: Column, provider: Column) -> Column:
    """The given kind, else ``none`` without a provider and ``unknown`` with one."""
    return F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.when(provider == "none", "none").otherwise("unknown"))
