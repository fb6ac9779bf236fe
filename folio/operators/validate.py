"""Expected page texts against the text found in an extracted layer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions.lines import edit_script


def found_lines(lines: list[str], key: str) -> int:
    """How many of ``lines`` (repeated ones each) the text ``key`` holds: one automaton over the distinct lines, one pass over the text."""
    if not lines or not key:
        return 0
    count = Counter(lines)
    automaton = ahocorasick.Automaton()
    for line in count:
        automaton.add_word(line, line)
    automaton.make_automaton()
    seen: set[str] = set()
    for _, line in automaton.iter(key):
        seen.add(line)
        if len(seen) == len(count):
            break
    return sum(count[line] for line in seen)


def _found(lines: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([found_lines(list(a), k) for a, k in zip(lines, key, strict=True)], dtype="int32")


def page_matches(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """Per expected page (page, text; null is empty): how many of its lines the extracted text (page, found) holds, in any order."""
    rows = expected.join(extracted, "page", "left").select("page", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("found", F.lit("")).alias("found"))
    rows = rows.select("page", T.match_lines(F.col("text")).alias("lines"), T.match_key(F.col("found")).alias("key"))
    rows = rows.withColumn("matched", F.pandas_udf(_found, "int")("lines", "key"))
    size, matched = F.size("lines"), F.col("matched")
    return rows.select("page", (size > 0).alias("expected_filled"), (F.col("key") != "").alias("extracted_filled"), size.alias("expected_lines"), matched.alias("matched_lines"), F.when(size == 0, 1.0).otherwise(matched / size).alias("line_ratio"))


def rollup(pages: DataFrame, min_coverage: float = 1.0, min_ratio: float = 0.85) -> DataFrame:
    """One row: coverage, mean and least line ratio of the filled pages, and whether all is well."""
    filled = F.col("expected_filled")
    out = pages.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(filled).alias("expected_filled"),
        F.count_if(filled & F.col("extracted_filled")).alias("covered"),
        F.coalesce(F.avg(F.when(filled, F.col("line_ratio"))), F.lit(1.0)).alias("mean_ratio"),
        F.coalesce(F.min(F.when(filled, F.col("line_ratio"))), F.lit(1.0)).alias("min_ratio"),
    )
    coverage = F.when(F.col("expected_filled") > 0, F.col("covered") / F.col("expected_filled")).otherwise(1.0)
    return out.withColumn("coverage", coverage).withColumn("ok", (F.col("coverage") >= min_coverage) & (F.col("min_ratio") >= min_ratio))


def failing(pages: DataFrame, min_ratio: float = 0.85) -> DataFrame:
    return pages.where(F.col("expected_filled") & (~F.col("extracted_filled") | (F.col("line_ratio") < min_ratio)))


def first_failing(pages: DataFrame, k: int, min_ratio: float = 0.85) -> DataFrame:
    return failing(pages, min_ratio).orderBy("page").limit(k)


def line_diff(pages: DataFrame) -> DataFrame:
    """(page, seq, op, line) of (page, text, found): an edit script has a traceback, which no built-in expresses."""

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, n, op, line) for p, a, b in zip(batch.page, batch.a, batch.b, strict=True) for n, (op, line) in enumerate(edit_script(list(a), list(b)))]
            yield pd.DataFrame(rows, columns=["page", "seq", "op", "line"])

    lines = pages.select("page", T.dump_lines(F.coalesce("text", F.lit(""))).alias("a"), T.dump_lines(F.coalesce("found", F.lit(""))).alias("b"))
    return lines.mapInPandas(diff, "page long, seq int, op string, line string")


def dumps(pages: DataFrame, texts: DataFrame, k: int, min_ratio: float = 0.85) -> DataFrame:
    """(page, expected, extracted, value): both texts and a readable diff of the first ``k`` failing pages."""
    chosen = first_failing(pages, k, min_ratio)
    own = texts.join(F.broadcast(chosen.select("page")), "page")
    ops = line_diff(own)
    shown = F.concat(F.when(F.col("op") == "=", " ").otherwise(F.col("op")), F.col("line"))
    body = ops.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("seq", shown.alias("s")))).alias("b"))
    head = F.format_string("page=%d\nexpected_lines=%d matched_lines=%d line_ratio=%.4f\n--- expected\n+++ extracted\n", "page", "expected_lines", "matched_lines", "line_ratio")
    both = own.select("page", F.coalesce("text", F.lit("")).alias("expected"), F.coalesce("found", F.lit("")).alias("extracted"))
    rows = chosen.join(both, "page", "left").join(body, "page", "left")
    return rows.select("page", "expected", "extracted", F.concat(head, F.coalesce(F.array_join(F.transform("b", lambda x: x["s"]), "\n"), F.lit("")), F.lit("\n")).alias("value"))
