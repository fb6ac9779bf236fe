"""What turns files into recognised pages: a protocol, and a fixed one for tests and dry runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.plans.run import lines_to_document
from folio.session import keep, ship

#: A callback that is told (phase, stage, done, total).
Progress = Callable[[str, str, int, int], None]


@dataclass(frozen=True)
class Recognition:
    """Pages and blocks of the data model, and what was seen while they were made."""

    pages: DataFrame
    blocks: DataFrame
    #: Network samples (pid, endpoint) of the run, where it was watched; with ``input_pdf`` a sample counts against its file alone.
    samples: DataFrame | None = None
    selfcheck_ok: bool = True
    timings: dict[str, float] = field(default_factory=dict)
    warnings: tuple[str, ...] = ()
    #: Whether the recognizer can make its artifacts again from corrected pages; and whether these are such.
    can_rebuild: bool = False
    from_corrected: bool = False
    #: Files that could not be recognised (input_pdf, error); they have no pages.
    errors: DataFrame | None = None


class Recognizer(Protocol):
    name: str

    def recognize(self, files: DataFrame, corrected: tuple[DataFrame, DataFrame] | None = None, progress: Progress | None = None) -> Recognition:
        """Pages and blocks of ``files`` (input_pdf); with ``corrected`` pages and blocks, artifacts made from those."""
        ...


class FixedRecognizer:
    """One page of fixed lines for every file."""

    name = "fixed"

    def __init__(self, lines: tuple[str, ...] = ("recognised text",), can_rebuild: bool = True, samples: DataFrame | None = None):
        self.lines, self.can_rebuild, self.samples = lines, can_rebuild, samples

    def recognize(self, files: DataFrame, corrected: tuple[DataFrame, DataFrame] | None = None, progress: Progress | None = None) -> Recognition:
        for phase in ("document_started", "document_done") if progress else ():
            progress(phase, "recognize", int(phase == "document_done"), 1)
        if corrected is not None:
            return Recognition(*corrected, self.samples, can_rebuild=self.can_rebuild, from_corrected=True)
        rows = files.select(F.col("input_pdf").alias("source_pdf"), F.lit(1).alias("page"), F.posexplode(F.array(*map(F.lit, self.lines))).alias("pos", "text"))
        pages, blocks = lines_to_document(rows.withColumn("y0", F.col("pos").cast("double")).withColumn("x0", F.lit(0.0)))
        return Recognition(pages, blocks, self.samples, can_rebuild=self.can_rebuild)


class LineRecognizer(FixedRecognizer):
    """Lines that an external program left in a table (source_pdf, page, pos, text, y0, x0), and its pages (source_pdf, page), where some have no line."""

    name = "lines"

    def __init__(self, lines: DataFrame, can_rebuild: bool = False, samples: DataFrame | None = None, pages: DataFrame | None = None):
        self.table, self.can_rebuild, self.samples, self.pages = lines, can_rebuild, samples, pages

    def recognize(self, files: DataFrame, corrected: tuple[DataFrame, DataFrame] | None = None, progress: Progress | None = None) -> Recognition:
        if corrected is not None:
            return super().recognize(files, corrected, progress)
        names = files.select(F.col("input_pdf").alias("source_pdf")).distinct()
        pages = self.pages.join(names, "source_pdf", "left_semi") if self.pages is not None else None
        return Recognition(*lines_to_document(self.table.join(names, "source_pdf", "left_semi"), pages), self.samples, can_rebuild=self.can_rebuild)


class CallRecognizer(FixedRecognizer):
    """Calls ``read`` for every file, inside tasks: path -> lines (page, text, y0, x0), where a page without lines has one without a text.

    A call that raises makes an error of its own file, and nothing of that file is kept; the others go on.
    """

    name = "call"

    def __init__(self, read: Callable[[str], Iterable[tuple[int, str | None, float, float]]], can_rebuild: bool = False, samples: DataFrame | None = None):
        self.read, self.can_rebuild, self.samples = read, can_rebuild, samples

    def recognize(self, files: DataFrame, corrected: tuple[DataFrame, DataFrame] | None = None, progress: Progress | None = None) -> Recognition:
        if corrected is not None:
            return super().recognize(files, corrected, progress)
        ship(files.sparkSession)
        read = self.read

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for path in batch["input_pdf"]:
                    try:
                        rows = [(path, int(page), k, text, float(y), float(x), None) for k, (page, text, y, x) in enumerate(read(path))]
                    except Exception as e:  # noqa: BLE001  an error is a row
                        rows = [(path, None, None, None, None, None, f"{e}"[:1000] or type(e).__name__)]
                    out = pd.DataFrame(rows, columns=["source_pdf", "page", "pos", "text", "y0", "x0", "error"], dtype=object)
                    yield out

        found = keep(files.select("input_pdf").mapInPandas(call, "source_pdf string, page int, pos int, text string, y0 double, x0 double, error string"), "recognised")
        lines = found.where("error is null").drop("error")
        errors = found.where("error is not null").select(F.col("source_pdf").alias("input_pdf"), "error")
        return Recognition(*lines_to_document(lines), self.samples, can_rebuild=self.can_rebuild, errors=errors)
