"""Gold pages against predicted pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import metrics as M
from folio.functions import text as T
from folio.operators import model


def predicted(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source_pdf, page, p_text, p_code, p_types): code blocks in stored order, and the types that occur.

    Of several pages with one number the last counts, by its place ``page_pos`` in the
    document where there is one; its blocks are those with the same ``page_pos``.
    """
    placed = "page_pos" in pages.columns and "page_pos" in blocks.columns
    key = ["source_pdf", "page", "page_pos"] if placed else ["source_pdf", "page"]
    own = blocks.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("block_type") == "code", F.struct("pos", "text")))).alias("code"),
        F.collect_set(F.when(T.blank(F.col("block_type")), "paragraph").otherwise(F.col("block_type"))).alias("p_types"),
    )
    place = ["page_pos"] if "page_pos" in pages.columns else []
    last = model.last_of(pages.select("source_pdf", "page", *place, F.col("text").alias("p_text")), ["source_pdf", "page"], "page_pos")
    rows = last.join(own, key, "left")
    return rows.select("source_pdf", "page", "p_text", F.coalesce(F.array_join(F.transform("code", lambda x: x["text"]), "\n"), F.lit("")).alias("p_code"), F.coalesce("p_types", F.array().cast("array<string>")).alias("p_types"))


def per_page(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The five metrics of every gold page; a metric without gold, or of a missing page, is null."""
    rows = gold.join(pred.withColumn("__found", F.lit(True)), ["source_pdf", "page"], "left")
    found = F.coalesce("__found", F.lit(False))
    has = lambda c: found & ~T.blank(F.col(c))
    asked = lambda c: F.when(has(c), T.normalize_prose(F.col(c)))
    snippets = F.coalesce("reading_order_snippets", F.array().cast("array<string>"))
    # The page is normalised once, for both snippets and their places.
    rows = rows.withColumn("__prose", T.normalize_prose(F.col("p_text")))
    rows = rows.withColumn("__errors", M.best_snippet_errors(F.array(asked("prose_kr"), asked("prose_mixed")), F.col("__prose")))
    return rows.select(
        "source_pdf",
        "page",
        (~found).alias("missing_prediction"),
        F.when(has("prose_kr"), F.get("__errors", F.lit(0))).alias("prose_cer"),
        F.when(has("prose_mixed"), F.get("__errors", F.lit(1))).alias("mixed_cer"),
        F.when(has("code"), M.code_line_accuracy(F.col("code"), F.col("p_code"))).alias("code_accuracy"),
        F.when(found & (F.size(T.unique_strings(F.coalesce("expected_block_types", F.array().cast("array<string>")))) > 0), M.set_f1(F.col("expected_block_types"), F.col("p_types"))).alias("layout_f1"),
        F.when(found & (F.size(snippets) > 0), ~M.in_order(M.snippet_positions(F.col("__prose"), snippets, normalised=True))).alias("order_error"),
    )


def summary(pages: DataFrame) -> DataFrame:
    """Means of what is there; the ratio of pages out of order; every gold page counts as evaluated."""
    checked = F.count("order_error")
    return pages.agg(
        F.avg("prose_cer").alias("prose_cer"),
        F.avg("mixed_cer").alias("mixed_cer"),
        F.avg("code_accuracy").alias("code_accuracy"),
        F.avg("layout_f1").alias("layout_f1"),
        M.ratio(F.count_if("order_error"), checked).alias("order_error_ratio"),
        F.count(F.lit(1)).alias("evaluated_pages"),
        F.count_if("missing_prediction").alias("missing_pages"),
    )


def result(pages: DataFrame) -> DataFrame:
    """One row (summary, per_page): what an evaluation file holds; of a page evaluated twice the last row counts."""
    metrics = ["missing_prediction", "prose_cer", "mixed_cer", "code_accuracy", "layout_f1", "order_error"]
    one = model.last_of(pages.select("source_pdf", "page", *metrics), ["source_pdf", "page"], "__none")
    per = one.groupBy("source_pdf").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", F.struct(*metrics).alias("metrics"))))).alias("per_page"))
    return per.crossJoin(F.broadcast(summary(pages).select(F.struct("*").alias("summary")))).select("source_pdf", "summary", "per_page")
