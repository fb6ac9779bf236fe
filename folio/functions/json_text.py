"""Model answers as text: JSON objects inside prose, and payload shapes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import text as T

#: A string (closed or not), or a brace outside strings.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.S)


def find_object(text: str | None) -> str | None:
    """The first balanced {...} of a model's answer, whether it parses or not.

    A code fence around the answer is taken off.  Without a closing brace it is all from
    the opening one, without an opening brace the whole text.
    """
    if text is None:
        return None
    body = text.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    start = body.find("{")
    if start < 0:
        return body
    depth = 0
    for token in _TOKEN.finditer(body, start):
        depth += {"{": 1, "}": -1}.get(token[0], 0)
        if depth == 0:
            return body[start : token.end()]
    return body[start:]


def first_json_object(c: Column) -> Column:
    """In Arrow batches: a scanner with nesting is beyond regular expressions."""

    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(find_object)

    return F.pandas_udf(scan, "string")(c)


def answer_text(payload: Column) -> Column:
    """The answer's text: ``output_text``, else the first choice's content, else the contents of all output items, a line each; null without any.

    A content is a text, or a list of texts and of objects with a ``text`` or ``value``, which are lines too.
    """
    part = lambda v, path: F.try_variant_get(v, path, "variant")

    def text(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def content(v: Column) -> Column:
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(text(x), text(part(x, "$.text")), text(part(x, "$.value"))))
        return F.coalesce(text(v), F.when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(F.filter(items, lambda x: x.isNotNull()), "\n")))

    filled = lambda c: F.when(~T.blank(c), c)
    doc = F.try_parse_json(payload)
    outputs = F.transform(F.try_variant_get(doc, "$.output", "array<variant>"), lambda x: filled(content(part(x, "$.content"))))
    whole = F.nullif(F.array_join(F.filter(outputs, lambda x: x.isNotNull()), "\n"), F.lit(""))
    return F.coalesce(filled(text(part(doc, "$.output_text"))), filled(content(part(doc, "$.choices[0].message.content"))), whole)
