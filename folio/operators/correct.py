"""Merging proposed corrections under an edit guard."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import model, order
from folio.session import keep


@dataclass(frozen=True)
class Guard:
    """What a correction must not touch.  A guard that protects nothing stands for the default."""

    code_blocks: bool = True
    numbers: bool = True
    urls: bool = True
    max_edit_ratio: float = 0.35

    def resolved(self) -> Guard:
        return self if self.code_blocks or self.numbers or self.urls or self.max_edit_ratio else Guard()


def protected(block_type: Column, source: Column, guard: Guard = Guard()) -> Column:
    """Whether a block is code, or holds an address or a number that the guard protects."""
    out = F.lit(False)
    if guard.code_blocks:
        out = out | (F.lower(block_type) == "code")
    if guard.urls:
        out = out | (F.size(T.url_tokens(source)) > 0)
    if guard.numbers:
        out = out | (F.size(T.number_tokens(source)) > 0)
    return out


def refusal(block_type: Column, source: Column, proposed: Column, guard: Guard = Guard()) -> Column:
    """Why a proposal is refused, or null; the cheap tests come first and the edit distance stops at the limit."""
    guard = guard.resolved()

    def judge(s: Column) -> Column:
        src, new = s["src"], s["new"]
        out = F.when(src == new, F.lit(None).cast("string"))
        if guard.code_blocks:
            out = out.when(s["code"], "protected_code_block")
        if guard.numbers:
            out = out.when(T.number_tokens(src) != T.number_tokens(new), "protected_number_sequence")
        if guard.urls:
            out = out.when(T.url_tokens(src) != T.url_tokens(new), "protected_url")
        if guard.max_edit_ratio > 0:
            size = F.char_length(src)
            most = F.floor(size * guard.max_edit_ratio + 1e-9).cast("int")
            # Word by word is an upper bound, and settles most corrections; else small limits come first, as the work grows with the limit.
            size_of = lambda w: F.coalesce(F.char_length(w) + 1, F.lit(0))
            changed = F.zip_with(F.split(src, " "), F.split(new, " "), lambda v, w: F.when(v.eqNullSafe(w), 0).otherwise(F.greatest(size_of(v), size_of(w))))
            within = lambda limit: F.call_function("levenshtein", src, new, F.least(limit, most)) >= 0
            far = F.when(F.abs(F.char_length(new) - size) > most, F.lit(True)).when(F.aggregate(changed, F.lit(0), lambda s, x: s + x) <= most, F.lit(False))
            for part in (256, 64, 16):
                far = far.when(within(F.floor(size / part).cast("int") + 1), F.lit(False))
            out = out.when((src != "") & far.otherwise(~within(most)), "edit_distance_limit_exceeded")
        return out

    return T.let(F.struct(T.utrim(source).alias("src"), T.utrim(proposed).alias("new"), (F.lower(block_type) == "code").alias("code")), judge)


def apply_blocks(blocks: DataFrame, proposals: DataFrame, guard: Guard = Guard()) -> DataFrame:
    """Normalised blocks with block proposals (source_pdf, page, block_id, p_text, p_status, p_reasons, p_protected, p_notes) merged in.

    Of several proposals for a block the last counts (by ``p_seq`` where there is one, else
    as they come); of several blocks with one id on a page the last is changed.
    """
    guard = guard.resolved()
    key = [*model.PAGE_KEY, "block_id"]
    given_rows = model.last_of(proposals, key, "p_seq").drop("p_seq")
    rows = blocks.withColumn("__last", F.max("n").over(Window.partitionBy(*key))).join(given_rows.withColumn("__given", F.lit(True)), key, "left")
    given = F.coalesce("__given", F.lit(False)) & (F.col("n") == F.col("__last"))
    candidate = F.coalesce(F.nullif(T.utrim(F.col("p_text")), F.lit("")), F.col("source_text"))
    rows = rows.withColumn("__new", candidate).withColumn("__why", F.when(given, refusal(F.col("block_type"), F.col("source_text"), F.col("__new"), guard)))
    refused, same = F.col("__why").isNotNull(), F.col("__new") == F.col("source_text")
    reasons = T.unique_strings(F.coalesce("p_reasons", F.array().cast("array<string>")))
    kept_reasons = F.when(F.size(reasons) > 0, reasons).otherwise(F.when(same, F.array(F.lit("no_change"))).otherwise(F.array(F.lit("provider_output"))))
    status = F.when(refused, "rejected").otherwise(F.coalesce(F.nullif("p_status", F.lit("")), F.when(same, "unchanged").otherwise("corrected")))
    merged = F.struct(
        status.alias("status"),
        (~refused & ~same).alias("edited"),
        F.when(refused, F.concat(reasons, F.array("__why"))).otherwise(kept_reasons).alias("reasons"),
        (F.coalesce("p_protected", F.lit(False)) | protected(F.col("block_type"), F.col("source_text"), guard)).alias("protected"),
        T.unique_strings(F.coalesce("p_notes", F.array().cast("array<string>"))).alias("notes"),
    )
    rows = rows.withColumn("correction", F.when(given, merged).otherwise(F.col("correction")))
    rows = rows.withColumn("text", F.when(~given, F.col("text")).when(refused, F.col("source_text")).otherwise(F.col("__new")))
    return rows.select(*blocks.columns)


def apply_pages(pages: DataFrame, blocks: DataFrame, page_proposals: DataFrame) -> DataFrame:
    """Pages with proposed status and notes; the text of a page with a proposal is joined again from its blocks.

    Of several proposals for a page the last status that is not empty counts, and the last notes that are not.
    """
    own = "p_seq" in page_proposals.columns
    at = F.col("p_seq") if own else F.monotonically_increasing_id()
    page_proposals = page_proposals.withColumn("__at", at).groupBy(*model.PAGE_KEY).agg(
        F.max_by("page_status", F.when(F.col("page_status") != "", F.col("__at"))).alias("page_status"),
        F.max_by("page_notes", F.when(F.size("page_notes") > 0, F.col("__at"))).alias("page_notes"),
    )
    texts = blocks.groupBy(*model.PAGE_KEY).agg(model.join_texts(F.col("text"), F.col("n")).alias("__text"))
    rows = pages.join(page_proposals.withColumn("__given", F.lit(True)), model.PAGE_KEY, "left").join(texts, model.PAGE_KEY, "left")
    given = F.coalesce("__given", F.lit(False))
    status = F.coalesce(F.nullif("page_status", F.lit("")), F.col("correction.status"))
    notes = F.when(F.coalesce(F.size("page_notes"), F.lit(0)) > 0, F.col("page_notes")).otherwise(F.col("correction.notes"))
    correction = F.struct(status.alias("status"), F.col("correction.changed_blocks").alias("changed_blocks"), F.col("correction.total_blocks").alias("total_blocks"), notes.alias("notes"))
    return rows.withColumn("text", F.when(given, F.coalesce("__text", F.lit(""))).otherwise(F.col("text"))).withColumn("correction", correction).select(*pages.columns)


def flatten_proposals(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page and block proposals from nested answers (source_pdf, pages), with their order (``p_seq``; by ``answer`` first, where there is such a column)."""
    answer = F.col("answer").cast("long") if "answer" in answers.columns else F.lit(0).cast("long")
    p = answers.select("source_pdf", answer.alias("answer"), F.posexplode("pages").alias("pos", "p"))
    pages = p.select("source_pdf", "p.page", F.col("p.status").alias("page_status"), F.col("p.notes").alias("page_notes"), F.struct("answer", "pos").alias("p_seq"))
    b = p.select("source_pdf", "answer", "p.page", "pos", F.posexplode("p.blocks").alias("i", "b"))
    return pages, b.select("source_pdf", "page", F.struct("answer", "pos", "i").alias("p_seq"), "b.block_id", *[F.col(f"b.{c}").alias(f"p_{c}") for c in ("text", "status", "reasons", "protected", "notes")])


def unmatched(blocks: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals for blocks that do not exist."""
    return proposals.join(blocks, [*model.PAGE_KEY, "block_id"], "left_anti")


def request_counters(requests: DataFrame) -> DataFrame:
    """One row of a table of requests (source_pdf, pages, seconds): how many, their seconds and the pages done."""
    return requests.agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("request_seconds"), F.coalesce(F.sum("pages"), F.lit(0)).cast("long").alias("completed_pages"))


def requests(pages: DataFrame, size: int = 1) -> DataFrame:
    """The requests of a correction loop, in order: source_pdf, batch, pages, current_page (the last of the batch), completed_pages (so far) and total_pages."""
    batches = page_batches(pages, size).groupBy("source_pdf", "batch").agg(F.count(F.lit(1)).alias("pages"), F.max("page").alias("current_page"))
    totals = batches.groupBy("source_pdf").agg(F.sum("pages").alias("total_pages"))
    return order.running(batches, ["source_pdf"], ["batch"], completed_pages=F.col("pages")).join(totals, "source_pdf")


def page_batches(pages: DataFrame, size: int = 1) -> DataFrame:
    """(source_pdf, page, batch): groups of ``size`` pages in a row, blank pages without blocks left out; pages are numbered by ranges, so no document is one task."""
    rows = pages.where(~(T.blank(F.col("source_text")) & (F.col("correction.total_blocks") == 0))).select("source_pdf", "page")
    return order.numbered(rows, ["source_pdf"], ["page"]).select("source_pdf", "page", F.floor(F.col("index") / max(1, size)).alias("batch"))


def prompt_rows(blocks: DataFrame, guard: Guard = Guard()) -> DataFrame:
    """(source_pdf, page, prompt): what a correction model is shown of a page."""
    item = F.struct("n", "block_id", "block_type", "reading_order", "source_text", "confidence", protected(F.col("block_type"), F.col("source_text"), guard).alias("protected"))
    rows = blocks.groupBy(*model.PAGE_KEY).agg(F.array_sort(F.collect_list(item)).alias("b"))
    return rows.select("source_pdf", "page", F.to_json(F.struct("page", F.transform("b", lambda x: x.dropFields("n")).alias("blocks"))).alias("prompt"))


#: A correction provider: numbered blocks -> nested answers.
Provider = Callable[[DataFrame], DataFrame]


def run_in_batches(pages: DataFrame, blocks: DataFrame, provider: Provider, size: int = 1, guard: Guard = Guard()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, blocks, counters) of :func:`run` where the provider sees its blocks with the ``batch`` of their page, and blank pages not at all.

    The provider may give the ``seconds`` of its answers by (source_pdf, batch); the counters are
    those of ``request_counters``.
    """
    b = model.normalize_blocks(blocks)
    asked = requests(model.normalize_pages(pages, b), size)
    groups = page_batches(model.normalize_pages(pages, b), size)
    answers = keep(provider(b.join(groups, ["source_pdf", "page"])), "answers")
    out = run(pages, blocks, lambda _: answers, guard)
    timed = answers.groupBy("source_pdf", "batch").agg(F.sum("seconds").alias("seconds")) if {"batch", "seconds"} <= set(answers.columns) else None
    rows = asked.withColumn("seconds", F.lit(0.0)) if timed is None else asked.join(timed, ["source_pdf", "batch"], "left").fillna({"seconds": 0.0})
    return *out, request_counters(rows)


def run(pages: DataFrame, blocks: DataFrame, provider: Provider | None, guard: Guard = Guard()) -> tuple[DataFrame, DataFrame]:
    """Normalise, merge the provider's answers, normalise again.  A page's status is set before the merge, so only an explicit one changes it."""
    b = model.normalize_blocks(blocks)
    p = model.normalize_pages(pages, b)
    if provider is None:
        return p, b
    page_proposals, block_proposals = flatten_proposals(provider(b))
    b = apply_blocks(b, block_proposals, guard)
    p = apply_pages(p, b, page_proposals)
    b = model.normalize_blocks(b.drop("n"))
    return model.normalize_pages(p, b), b
