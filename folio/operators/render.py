"""Text and Markdown of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import order

FENCE = "```"


def page_text(pages: DataFrame) -> DataFrame:
    """(source_pdf, value): trimmed page texts with an empty line between, one line feed at the end."""
    out = pages.groupBy("source_pdf").agg(F.array_sort(F.collect_list(F.struct("page", T.utrim(F.col("text")).alias("t")))).alias("p"))
    return out.select("source_pdf", F.concat(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("value"))


def page_markdown(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source_pdf, page, value): a page's heading and its blocks by type; blank blocks are left out."""
    t = T.utrim(F.col("text"))
    shown = (
        F.when(F.col("block_type") == "heading", F.concat(F.lit("### "), t))
        .when(F.col("block_type") == "code", F.concat(F.lit(f"{FENCE}text\n"), t, F.lit(f"\n{FENCE}")))
        .when(F.col("block_type") == "caption", F.concat(F.lit("*"), t, F.lit("*")))
        .otherwise(t)
    )
    body = blocks.where(t != "").groupBy("source_pdf", "page").agg(F.array_sort(F.collect_list(F.struct("n", shown.alias("s")))).alias("b"))
    rows = pages.select("source_pdf", "page").join(body, ["source_pdf", "page"], "left")
    lines = F.concat(F.array(F.format_string("## Page %d", "page")), F.coalesce(F.transform("b", lambda x: x["s"]), F.array().cast("array<string>")), F.array(F.lit("")))
    return rows.select("source_pdf", "page", F.array_join(lines, "\n").alias("value"))


def markdown(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source_pdf, value): the Markdown of whole documents."""
    out = page_markdown(pages, blocks).groupBy("source_pdf").agg(F.array_sort(F.collect_list(F.struct("page", "value"))).alias("p"))
    return out.select("source_pdf", F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))


def write_text(pages: DataFrame, path: str) -> None:
    """The text of documents of any size, in ordered files: what ``page_text`` holds, and no document in one row."""
    t = T.utrim(F.col("text"))
    order.write_ordered(pages.select("source_pdf", "page", "text"), path, "source_pdf", "page", t, F.concat(F.lit("\n"), t))


def write_markdown(pages: DataFrame, blocks: DataFrame, path: str) -> None:
    """The Markdown of documents of any size, in ordered files; a line feed ends it."""
    value = F.col("value")
    order.write_ordered(page_markdown(pages, blocks), path, "source_pdf", "page", value, value)


def text_layout(pages: DataFrame) -> DataFrame:
    """(source_pdf, page, start, size): the bytes of each page in its document's text, by prefix sums."""
    size = F.octet_length(T.utrim(F.col("text"))).cast("long")
    rows = order.running(pages.select("source_pdf", "page", size.alias("size")), ["source_pdf"], ["page"], until=F.col("size") + 2)
    return rows.select("source_pdf", "page", (F.col("until") - F.col("size") - 2).alias("start"), "size")
