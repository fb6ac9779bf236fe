"""Readers and writers of documents, gold pages, reports and progress lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from folio import schemas
from folio.functions import json_text
from folio.functions import text as T
from folio.operators import order


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents with their pages nested, from ``pages.json`` files (one object per file)."""
    return spark.read.schema(schemas.DOCUMENT).option("multiLine", True).json(path)


def read_raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents whose pages stay JSON texts (engine, source_pdf, pages), for merging without a page schema."""
    docs = spark.read.schema("engine string, source_pdf string, pages array<variant>").option("multiLine", True).json(path)
    return docs.select("engine", "source_pdf", F.transform("pages", lambda p: F.to_json(p)).alias("pages"))


def read_tolerant_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents whose pages may miss fields or hold them in the wrong type: such a page keeps what can be read of it."""
    raw = read_raw_documents(spark, path)
    return raw.select("engine", "source_pdf", F.transform("pages", lambda p: F.from_json(p, schemas.PAGE_FIELDS, {"mode": "PERMISSIVE"})).alias("pages"))


def explode_pages(docs: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(source_pdf, page, ...): the page number falls back to the position, sizes to 0, texts to each other.

    With ``keep_empty`` a document without pages has one row, whose ``page`` is null.
    """
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return page_rows(docs.select("source_pdf", explode("pages").alias("pos", "p")))


def page_rows(rows: DataFrame) -> DataFrame:
    """The page columns of (source_pdf, pos, p)."""
    joined = F.array_join(F.filter(F.transform(F.col("p.blocks"), lambda b: T.utrim(F.coalesce(b["text"], F.lit("")))), lambda x: x != ""), "\n")
    text = F.coalesce(F.nullif(T.utrim(F.col("p.text")), F.lit("")), joined, F.lit(""))
    return rows.select(
        "source_pdf",
        "pos",
        F.when(F.col("p.page") >= 1, F.col("p.page")).otherwise(F.col("pos") + 1).alias("page"),
        F.greatest(F.lit(0), F.coalesce("p.width", F.lit(0))).alias("width"),
        F.greatest(F.lit(0), F.coalesce("p.height", F.lit(0))).alias("height"),
        F.coalesce("p.is_blank", F.lit(False)).alias("is_blank"),
        text.alias("text"),
        F.coalesce(F.when(~T.blank(F.col("p.source_text")), F.col("p.source_text")), text).alias("source_text"),
        F.coalesce("p.blocks", F.array().cast(f"array<{schemas.BLOCK}>")).alias("blocks"),
        F.col("p.correction").alias("correction"),
    )


def explode_blocks(pages: DataFrame) -> DataFrame:
    """(source_pdf, page, pos, ...block fields) of exploded pages."""
    rows = pages.select("source_pdf", "page", F.posexplode("blocks").alias("pos", "b"))
    return rows.select("source_pdf", "page", "pos", "b.*")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(schemas.GOLD).option("multiLine", True).json(path)
    return docs.select("source_pdf", F.explode("pages").alias("g")).select("source_pdf", "g.*")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REPORT).option("multiLine", True).json(path)


def page_count(docs: DataFrame) -> DataFrame:
    return docs.select("source_pdf", F.when(F.col("pages").isNull(), 0).otherwise(F.size("pages")).alias("pages"))


def discover_files(spark: SparkSession, path: str, recursive: bool = False, suffix: str = ".pdf") -> DataFrame:
    """Paths of matching files of a folder, or the one file named, whatever the case of their suffix; contents are not read.

    No matching file is an error.
    """
    # Folders are no partitions, whatever their names; without ``recursive`` only what lies in the folder itself counts.
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = found.select(F.col("path").alias("input_pdf")).where(F.lower("path").endswith(suffix)).orderBy("input_pdf")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not recursive and store.exists(root) and store.getFileStatus(root).isDirectory():
        found = found.where(F.regexp_extract("input_pdf", r"^(.*)/[^/]*$", 1) == store.makeQualified(root).toString().rstrip("/"))
    if found.isEmpty():
        raise ValueError(f"no {suffix} file in {path}")
    return found


def parse_progress(lines: DataFrame, prefix: str = "PROGRESS ", column: str = "value") -> DataFrame:
    """(value, event): ``event`` is null for lines without the prefix or with bad JSON."""
    line = F.col(column)
    body = F.when(line.startswith(prefix), F.substr(line, F.lit(len(prefix) + 1)))
    event = F.from_json(body, schemas.PROGRESS, {"mode": "PERMISSIVE"})
    return lines.select(line.alias("value"), F.when(event["phase"].isNotNull(), event).alias("event"))


def join_answer_parts(parts: DataFrame) -> DataFrame:
    """(answer_id, text) from event-stream lines (answer_id, seq, line).

    The ``data:`` lines of an event, up to an empty line, are one payload; end marks are
    skipped, deltas and finished texts joined in order, and without any the completed
    answer counts.
    """
    ordered = Window.partitionBy("answer_id").orderBy("seq")
    event = F.sum((F.col("line") == "").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = parts.withColumn("event", event).where(F.col("line").startswith("data:"))
    data = F.array_sort(F.collect_list(F.struct("seq", F.trim(F.substr("line", F.lit(6))).alias("data"))))
    rows = lines.groupBy("answer_id", "event").agg(F.array_join(F.transform(data, lambda x: x["data"]), "\n").alias("data")).where("data <> '[DONE]'")
    field = lambda path: F.get_json_object("data", path)
    kind = F.coalesce(field("$.type"), F.lit(""))
    other = F.coalesce(field("$.delta"), json_text.answer_text(F.col("data")))
    part = F.when(kind == "response.output_text.delta", field("$.delta")).when(kind == "response.output_text.done", field("$.text")).when(kind != "response.completed", other)
    rows = rows.select("answer_id", "event", part.alias("part"), json_text.answer_text(F.coalesce(field("$.response"), F.lit("{}"))).alias("whole"))
    out = rows.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("event", "part")))).alias("d"), F.max_by("whole", F.when(F.col("whole").isNotNull(), F.col("event"))).alias("whole"))
    return out.select("answer_id", F.coalesce(F.nullif(F.array_join(F.transform("d", lambda x: x["part"]), ""), F.lit("")), "whole").alias("text"))


def sorted_fields(c: Column, kind: T_.DataType) -> Column:
    """The same value with the fields of all its structs in the order of their names."""
    if isinstance(kind, T_.StructType):
        inner = [sorted_fields(c.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*inner)) if inner else c
    if isinstance(kind, T_.ArrayType):
        return F.transform(c, lambda x: sorted_fields(x, kind.elementType))
    if isinstance(kind, T_.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(c))) if isinstance(kind.keyType, T_.StringType) and isinstance(kind.valueType, T_.AtomicType) else c
    return c


def as_json(df: DataFrame, indent: bool = False, sort_keys: bool = False) -> DataFrame:
    """(value): rows as JSON objects, with nulls; with ``sort_keys`` all keys in the order of their names."""
    if sort_keys:
        df = df.select(*[sorted_fields(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema, key=lambda f: f.name)])
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": str(indent).lower()}).alias("value"))


def write_json(df: DataFrame, path: str, indent: bool = False, sort_keys: bool = False) -> None:
    """JSON objects written by the executors: one a line, or indented by two blanks and each in a file of its own."""
    as_json(df, indent, sort_keys).write.mode("overwrite").option("maxRecordsPerFile", int(indent)).text(path)


def write_large_documents(pages: DataFrame, engine: str, path: str) -> None:
    """Documents of any size as JSON, from pages (source_pdf, page and any fields): a folder for each, whose files in the order of their names are one object; ``pages.read_pages`` reads it."""
    fields = F.to_json(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != "source_pdf"]))
    head = F.to_json(F.struct(F.lit(engine).alias("engine"), "source_pdf"))
    first = F.concat(F.substr(head, F.lit(1), F.char_length(head) - 1), F.lit(',"pages":['), "__json")
    rows = pages.select("source_pdf", "page", fields.alias("__json"))
    order.write_ordered(rows.withColumn("folder", F.col("source_pdf")), path, "folder", "page", first, F.concat(F.lit(","), "__json"), F.lit("]}"))


def read_json_rows(spark: SparkSession, path: str, schema: str, indent: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", indent).json(path)


def run_summary(reports: DataFrame) -> DataFrame:
    """One flat row for each report; timings that a report does not have are 0."""
    at = lambda key: F.coalesce(F.try_element_at("stage_timings", F.lit(key)), F.lit(0.0))
    minute = F.when((F.col("pages") > 0) & (F.col("elapsed_seconds") > 0), F.col("pages") / F.col("elapsed_seconds") * 60).otherwise(0.0)
    none = F.array().cast("array<string>")
    return reports.select("engine", "input_pdf", "profile", "elapsed_seconds", "pages", minute.alias("pages_per_minute"), at("ocr_seconds").alias("ocr_seconds"), at("pdf_seconds").alias("pdf_seconds"), at("total_seconds").alias("provider_seconds"), F.coalesce("warnings", none).alias("warnings"))


def has_warning(warnings: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(warnings, name), F.lit(False))


def progress_line(event: Column, prefix: str = "PROGRESS ") -> Column:
    return F.concat(F.lit(prefix), F.to_json(event))
