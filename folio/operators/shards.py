"""Page ranges of shards, and merging what shards made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions.text import union_strings


def ranges(documents: DataFrame, shards: int) -> DataFrame:
    """(source_pdf, shard, start, pages, error) of (source_pdf, page_count): contiguous, balanced, the first ones a page longer.

    Plain arithmetic, so no page has to be sorted.  A document with fewer pages than
    shards has one row, with an ``error`` and nothing else; :func:`check` raises for it.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    few = F.col("page_count") < shards
    rows = documents.withColumn("shard", F.explode(F.when(few, F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(shards - 1)))))
    base, extra = F.floor(F.col("page_count") / shards), F.pmod("page_count", F.lit(shards))
    error = F.when(few, F.format_string(f"{shards} shards for %d pages", F.col("page_count").cast("long")))
    return rows.select("source_pdf", "shard", (F.col("shard") * base + F.least(F.col("shard"), extra)).alias("start"), (base + (F.col("shard") < extra).cast("int")).alias("pages"), error.alias("error"))


def check(page_count: int, shards: int) -> None:
    if shards > page_count:
        raise ValueError(f"{shards} shards for {page_count} pages")


def shard_of(page_index, page_count, shards: int):
    """The shard (Column) that holds a page index (from 0)."""
    base, extra = F.floor(page_count / shards), F.pmod(page_count, F.lit(shards))
    long = extra * (base + 1)
    return F.when(page_index < long, F.floor(page_index / (base + 1))).otherwise(extra + F.floor((page_index - long) / F.greatest(base, F.lit(1))))


def merge(parts: list[DataFrame]) -> DataFrame:
    """Pages of all shards in one table; any order, since pages carry their number."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def merged_text(pages: DataFrame) -> DataFrame:
    """(source_pdf, value): non-empty page texts with an empty line between."""
    out = pages.where(~T.blank(F.col("text"))).groupBy("source_pdf").agg(F.array_sort(F.collect_list(F.struct("page", T.utrim(F.col("text")).alias("t")))).alias("p"))
    return out.select("source_pdf", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("value"))


def merged_warnings(shards: DataFrame) -> DataFrame:
    """(source_pdf, warnings): distinct warnings, in shard order."""
    out = shards.groupBy("source_pdf").agg(F.array_sort(F.collect_list(F.struct("shard", "warnings"))).alias("w"))
    return out.select("source_pdf", union_strings(F.flatten(F.transform("w", lambda x: x["warnings"]))).alias("warnings"))
