"""Recognition metrics, Column to Column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import nearest
from folio.functions import text as T
from folio.functions.lines import common_length
from folio.functions.text import let


def character_error_rate(reference: Column, prediction: Column) -> Column:
    """Edit distance over the reference's length; may exceed 1.  An empty reference gives 0 or 1."""
    ref, pred = T.normalize_prose(reference), T.normalize_prose(prediction)
    return let(F.struct(ref.alias("r"), pred.alias("p")), lambda s: F.when(s["r"] == "", F.when(s["p"] == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(s["r"], s["p"]) / F.char_length(s["r"])))


def _errors(snippets: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series(nearest.snippet_errors([None if x is None else list(x) for x in snippets], list(page)))


def best_snippet_errors(snippets: Column, page: Column) -> Column:
    """For normalised snippets (an array) and a normalised page: 0 if the page contains a snippet, else the least error of any line, 1 at most.

    An Arrow kernel over all pairs of a batch, whose limit is the best line so far.
    """
    return F.pandas_udf(_errors, "array<double>")(snippets, page)


def best_snippet_error(reference: Column, page: Column) -> Column:
    """The same for one snippet and page as they are."""
    return best_snippet_errors(F.array(T.normalize_prose(reference)), T.normalize_prose(page))[0]


def _accuracy(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    def one(r, p):
        if r is None or p is None:
            return None
        return common_length(r, p) / len(r) if len(r) else float(len(p) == 0)

    return pd.Series([one(r, p) for r, p in zip(reference, prediction, strict=True)], dtype="float64")


def code_line_accuracy(reference: Column, prediction: Column) -> Column:
    """Share of the reference's code lines that the prediction has in the same order; without code lines 1 if both have none.

    Built-in lambdas would copy a row of the table for every cell, so this is an Arrow kernel.
    """
    return F.pandas_udf(_accuracy, "double")(T.code_lines(reference), T.code_lines(prediction))


def set_f1(expected: Column, actual: Column) -> Column:
    """F1 of two sets of strings; two empty sets agree.  Expected values are trimmed, actual ones are not."""

    def score(s: Column) -> Column:
        ne, na, tp = F.size(s["e"]), F.size(s["a"]), F.size(F.array_intersect(s["e"], s["a"]))
        return F.when((ne == 0) & (na == 0), 1.0).when((ne == 0) | (na == 0) | (tp == 0), 0.0).otherwise(2.0 * tp / (ne + na))

    return let(F.struct(T.unique_strings(expected).alias("e"), F.array_distinct(actual).alias("a")), score)


def snippet_positions(page: Column, snippets: Column, normalised: bool = False) -> Column:
    """First place of each snippet in the page's search key, from 0; -1 if it is missing."""
    return let(T.key_of(page) if normalised else T.search_key(page), lambda key: F.transform(snippets, lambda s: F.instr(key, T.search_key(s)) - 1))


def in_order(positions: Column) -> Column:
    """Whether no snippet is missing and each starts after the one before."""

    def check(p: Column) -> Column:
        steps = F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(2), F.size(p)), lambda a, b: a < b)
        return F.forall(p, lambda x: x >= 0) & F.forall(steps, lambda ok: ok)

    return let(positions, check)


def ratio(part: Column, whole: Column) -> Column:
    """Null when there is nothing to divide by."""
    return F.when(whole != 0, part / whole)
