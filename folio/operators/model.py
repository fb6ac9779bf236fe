"""Pages and blocks: numbering, assembly, normalisation and the nested form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import recognition as R
from folio.functions import text as T

PAGE_KEY = ["source_pdf", "page"]


def last_of(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row of each key: the last by the column ``order``, or as rows come where there is no such column."""
    own = order in rows.columns
    rows = rows if own else rows.withColumn("__at", F.monotonically_increasing_id())
    at = order if own else "__at"
    rest = [c for c in rows.columns if c not in keys and c != "__at"]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(at)).alias("__last"))
    return out.select(*keys, *[F.col(f"__last.`{c}`").alias(c) for c in rest])


def line_order(lines: DataFrame) -> DataFrame:
    """Recognised lines with a reading order from the top, then from the left."""
    w = Window.partitionBy(*PAGE_KEY).orderBy("y0", "x0", "pos")
    return lines.withColumn("reading_order", F.row_number().over(w))


def recognized_blocks(lines: DataFrame) -> DataFrame:
    """Blocks from recognised lines (source_pdf, page, pos, text, y0, x0): cleaned, numbered, classified; empty ones go."""
    cleaned = lines.withColumn("text", R.normalize_line(F.col("text"))).where("text <> ''")
    return line_order(cleaned).withColumn("block_type", R.classify_block(F.col("text")))


def number_blocks(blocks: DataFrame) -> DataFrame:
    """Default reading orders and types, a dense order, and ids ``p{page}-b{n}`` where none is given."""
    rows = blocks.withColumn("reading_order", F.when(F.col("reading_order") >= 1, F.col("reading_order")).otherwise(F.col("pos") + 1))
    rows = rows.withColumn("block_type", T.or_default(F.col("block_type"), "paragraph"))
    w = Window.partitionBy(*PAGE_KEY).orderBy("reading_order", "pos")
    rows = rows.withColumn("n", F.row_number().over(w))
    given = F.when(~T.blank(F.col("block_id")), F.col("block_id"))
    return rows.withColumn("block_id", F.coalesce(given, F.format_string("p%d-b%d", "page", "n")))


def join_texts(text: Column, order: Column) -> Column:
    """Aggregate: trimmed, non-empty texts in order, one a line."""
    parts = F.array_sort(F.collect_list(F.when(~T.blank(text), F.struct(order.alias("o"), T.utrim(text).alias("t")))))
    return F.array_join(F.transform(parts, lambda x: x["t"]), "\n")


def page_texts(blocks: DataFrame) -> DataFrame:
    """(source_pdf, page, text, blocks, is_blank) assembled from numbered blocks."""
    out = blocks.groupBy(*PAGE_KEY).agg(join_texts(F.col("text"), F.col("n")).alias("text"), F.count(F.lit(1)).alias("blocks"))
    return out.withColumn("is_blank", F.col("text") == "")


def normalize_blocks(blocks: DataFrame) -> DataFrame:
    """Numbered blocks with texts, edit flag, status and reasons filled in."""
    rows = number_blocks(blocks)
    rows = rows.withColumn("source_text", F.when(F.coalesce("source_text", F.lit("")) == "", F.coalesce("text", F.lit(""))).otherwise(F.col("source_text")))
    rows = rows.withColumn("text", F.when(F.coalesce("text", F.lit("")) == "", F.col("source_text")).otherwise(F.col("text")))
    edited = F.col("text") != F.col("source_text")
    status = F.coalesce(F.when(~T.blank(F.col("correction.status")), F.col("correction.status")), F.when(edited, "corrected").otherwise("unchanged"))
    reasons = F.when(F.coalesce(F.size("correction.reasons"), F.lit(0)) > 0, F.col("correction.reasons")).otherwise(F.when(edited, F.array(F.lit("provider_output"))).otherwise(F.array(F.lit("no_change"))))
    return rows.withColumn(
        "correction",
        F.struct(status.alias("status"), edited.alias("edited"), reasons.alias("reasons"), F.coalesce("correction.protected", F.lit(False)).alias("protected"), F.coalesce("correction.notes", F.array().cast("array<string>")).alias("notes")),
    )


def normalize_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages with texts, counts and status from their normalised blocks; a page keeps a status it already has."""
    sums = blocks.groupBy(*PAGE_KEY).agg(
        F.count(F.lit(1)).cast("int").alias("total_blocks"),
        F.count_if("correction.edited").cast("int").alias("changed_blocks"),
        join_texts(F.col("source_text"), F.col("n")).alias("own_source"),
        join_texts(F.col("text"), F.col("n")).alias("own_text"),
    )
    rows = pages.join(sums, PAGE_KEY, "left").fillna({"total_blocks": 0, "changed_blocks": 0, "own_source": "", "own_text": ""})
    rows = rows.withColumn("source_text", F.when(T.blank(F.col("source_text")), F.col("own_source")).otherwise(F.col("source_text")))
    rows = rows.withColumn("text", F.when(T.blank(F.col("text")), F.col("own_text")).otherwise(F.col("text")))
    changed = (F.col("text") != F.col("source_text")) | (F.col("changed_blocks") > 0)
    status = F.coalesce(F.when(~T.blank(F.col("correction.status")), F.col("correction.status")), F.when(changed, "corrected").otherwise("unchanged"))
    rows = rows.withColumn("is_blank", F.col("is_blank") | (T.blank(F.col("text")) & (F.col("total_blocks") == 0)))
    notes = F.coalesce("correction.notes", F.array().cast("array<string>"))
    rows = rows.withColumn("correction", F.struct(status.alias("status"), F.col("changed_blocks"), F.col("total_blocks"), notes.alias("notes")))
    return rows.drop("total_blocks", "changed_blocks", "own_source", "own_text")


def changed_pages(pages: DataFrame) -> DataFrame:
    changed = (F.col("text") != F.col("source_text")) | (F.col("correction.changed_blocks") > 0) | (F.col("correction.status") != "unchanged")
    return pages.agg(F.count_if(changed).alias("changed_pages"), F.count(F.lit(1)).alias("pages"))


def nest(pages: DataFrame, blocks: DataFrame, engine: str) -> DataFrame:
    """One row per document with its pages and their blocks as arrays, in order."""
    b = blocks.groupBy(*PAGE_KEY).agg(F.array_sort(F.collect_list(F.struct("n", "block_id", "text", "source_text", "block_type", "reading_order", "correction"))).alias("blocks"))
    p = pages.drop("blocks").join(b, PAGE_KEY, "left")
    inner = F.struct("page", "width", "height", "is_blank", "text", "source_text", "blocks", "correction")
    return p.groupBy("source_pdf").agg(F.array_sort(F.collect_list(inner), lambda x, y: x["page"] - y["page"]).alias("pages")).withColumn("engine", F.lit(engine))


def artifact_pages(pages: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pages with the bounds they are drawn in and their image size, from the source's page sizes (source_pdf, page, source_width, source_height).

    Without a source page the page's own size counts, and US letter where it has none; such a page has a warning.
    """
    rows = pages.select("source_pdf", "page", F.greatest("width", F.lit(1)).alias("w"), F.greatest("height", F.lit(1)).alias("h")).join(last_of(bounds, PAGE_KEY, "__none"), PAGE_KEY, "left")
    there = (F.col("source_width") > 0) & (F.col("source_height") > 0)
    own = (F.col("w") > 1) & (F.col("h") > 1)
    side = lambda source, size, letter: F.when(there, F.col(source)).when(F.col("source_width").isNotNull() | own, F.col(size).cast("double")).otherwise(F.lit(letter))
    rows = rows.withColumn("bounds_width", side("source_width", "w", 612.0)).withColumn("bounds_height", side("source_height", "h", 792.0))
    image = lambda size, bound: F.greatest(F.col(size), F.col(bound).cast("int"), F.lit(1))
    warning = F.when(F.col("source_width").isNull(), F.format_string("corrected_page_missing_source_bounds_%d", "page"))
    return rows.select("source_pdf", "page", "bounds_width", "bounds_height", image("w", "bounds_width").alias("image_width"), image("h", "bounds_height").alias("image_height"), warning.alias("warning"))
