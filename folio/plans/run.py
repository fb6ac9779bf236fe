"""Recognised lines to corrected documents, texts and a report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio import schemas
from folio.functions import labels
from folio.functions import text as T
from folio.operators import correct, model, render
from folio.plans import config as C


class Result(NamedTuple):
    pages: DataFrame
    blocks: DataFrame
    text: DataFrame
    markdown: DataFrame
    report: DataFrame


def lines_to_document(lines: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, blocks) of recognised lines (source_pdf, page, pos, text, y0, x0); ``pages`` (source_pdf, page) names those that may have none.  A line without a text only names its page."""
    none = F.lit(None).cast("string")
    blocks = model.recognized_blocks(lines).select("source_pdf", "page", "pos", none.alias("block_id"), "text", none.alias("source_text"), "block_type", "reading_order", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast(schemas.BLOCK_CORRECTION).alias("correction"))
    named = lines.select("source_pdf", "page")
    pages = (named if pages is None else named.unionByName(pages.select("source_pdf", "page"))).distinct()
    pages = pages.select("source_pdf", "page", F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(False).alias("is_blank"), F.lit("").alias("text"), F.lit("").alias("source_text"), F.lit(None).cast(schemas.PAGE_CORRECTION).alias("correction"))
    return pages, blocks


def run(lines: DataFrame, provider: correct.Provider | None = None, profile: C.Profile | None = None) -> Result:
    profile = profile or C.Profile()
    pages, blocks = lines_to_document(lines)
    pages, blocks = correct.run(pages, blocks, provider if profile.provider != "none" else None, profile.guard)
    changed = model.changed_pages(pages).withColumn("provider", F.lit(profile.provider)).withColumn("output_mode", F.lit(profile.mode))
    return Result(pages, blocks, render.page_text(pages), render.markdown(pages, blocks), changed)


def write(result: Result, path: str) -> None:
    """Sidecar files: Parquet tables, and text and Markdown by document."""
    result.pages.write.mode("overwrite").parquet(f"{path}/pages")
    result.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    result.text.write.mode("overwrite").parquet(f"{path}/text")
    result.markdown.write.mode("overwrite").parquet(f"{path}/markdown")
    render.write_text(result.pages, f"{path}/document_text")
    render.write_markdown(result.pages, result.blocks, f"{path}/document_markdown")
    result.report.write.mode("overwrite").json(f"{path}/report")


#: Version and kind of a sidecar.
SIDECAR_VERSION, SIDECAR_KIND = "1", "corrected_document"


def sidecar(result: Result, path: str, engine: str, profile: C.Profile, applied: bool, mode: str, timings: dict[str, float], warnings: list[str]) -> DataFrame:
    """One row per document: what its corrected pages are, when and how they were made, and where its files lie."""
    at = {"pages_json": "pages", "text_path": "document_text", "markdown_path": "document_markdown"}
    kind = labels.credential_kind(F.lit(None).cast("string"), F.lit(profile.provider))
    return result.pages.select("source_pdf").distinct().select(
        F.lit(SIDECAR_VERSION).alias("version"),
        F.lit(SIDECAR_KIND).alias("kind"),
        F.lit(engine).alias("engine"),
        "source_pdf",
        T.rfc3339(F.current_timestamp()).alias("generated_at"),
        F.struct(*[F.lit(f"{path}/{x}").alias(k) for k, x in at.items()]).alias("source_artifacts"),
        F.struct(
            F.lit(profile.provider).alias("provider"),
            F.lit(applied).alias("applied"),
            F.lit(mode).alias("output_mode"),
            kind.alias("credential_kind"),
            F.lit(profile.model).alias("model"),
            F.array(*map(F.lit, warnings)).cast("array<string>").alias("warnings"),
            F.create_map(*[F.lit(x) for kv in timings.items() for x in kv]).cast("map<string,double>").alias("stage_timings"),
        ).alias("postprocess"),
    )
