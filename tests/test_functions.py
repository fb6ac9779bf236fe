"""Column functions on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from folio.functions import json_text, labels, lines
from folio.functions import metrics as M
from folio.functions import recognition as R
from folio.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.array(*map(F.lit, x)) if isinstance(x, list) and x else F.array().cast("array<string>") if isinstance(x, list) else F.lit(x)


@pytest.mark.parametrize(("raw", "want"), [(" a ", "a"), ("\t\n x y \r", "x y"), ("", ""), ("　가　", "가")])
def test_utrim(spark, raw, want):
    assert value(spark, T.utrim(lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("a \t\r\nb\t c\rd  ", "a\nb c\nd"), ("", ""), (" x ", "x")])
def test_normalize_prose(spark, raw, want):
    assert value(spark, T.normalize_prose(lit(raw))) == want


def test_normalize_code_keeps_inner_blanks_and_stops_at_line_feeds_only(spark):
    assert value(spark, T.normalize_code(lit("\n\na  b \t\n x \n\n"))) == "a  b\n x"


def test_code_lines_ignore_spacing_around_brackets(spark):
    assert value(spark, T.code_lines(lit('"lastName": "Smith",'))) == value(spark, T.code_lines(lit('"lastName":"Smith",')))
    assert value(spark, T.code_lines(lit("GET / users\n\n"))) == ["GET/users"]


@pytest.mark.parametrize(
    ("ref", "page", "want"),
    [("안녕하세요", "안녕하세요", 0.0), ("abc", "zzzzzzzz", 1.0), ("abcd", "x\nabxd", 0.25), ("", "x", 0.0), ("abc", "", 1.0), ("한글", "한굴", 0.5)],
)
def test_best_snippet_error(spark, ref, page, want):
    assert value(spark, M.best_snippet_error(lit(ref), lit(page))) == want


@pytest.mark.parametrize(("ref", "pred", "want"), [("", "", 0.0), ("", "x", 1.0), ("ab", "abcdef", 2.0)])
def test_character_error_rate(spark, ref, pred, want):
    assert value(spark, M.character_error_rate(lit(ref), lit(pred))) == want


@pytest.mark.parametrize(("ref", "pred", "want"), [("a=1\nb=2", "a=1\nb=3", 0.5), ("", "", 1.0), ("", "x", 0.0), ("a\nb\nc", "c\na\nb", 2 / 3), ("a", "", 0.0)])
def test_code_line_accuracy(spark, ref, pred, want):
    assert value(spark, M.code_line_accuracy(lit(ref), lit(pred))) == pytest.approx(want)


@pytest.mark.parametrize(("expected", "actual", "want"), [(["heading", "paragraph"], ["paragraph"], 2 / 3), ([], [], 1.0), (["a"], [], 0.0), ([" a "], ["a", "a"], 1.0), (["a"], ["b"], 0.0)])
def test_set_f1(spark, expected, actual, want):
    assert value(spark, M.set_f1(lit(expected), lit(actual))) == pytest.approx(want)


@pytest.mark.parametrize(
    ("page", "snippets", "want"),
    [("A then B", ["B", "A"], False), ("GET users/12 then JSON", ["GET /users/12", "JSON"], True), ("x x", ["x", "x"], False), ("abc", ["abc", "zz"], False), ("abc", ["!!"], True), ("가 나", ["가", "나"], True)],
)
def test_reading_order(spark, page, snippets, want):
    assert value(spark, M.in_order(M.snippet_positions(lit(page), lit(snippets)))) is want


@pytest.mark.parametrize(("raw", "want"), [(" 3강 소개", "3장 소개"), ("12 정", "12장"), ("get users/12", "get /users/12"), ("widget users/1", "widget users/1")])
def test_normalize_line(spark, raw, want):
    assert value(spark, R.normalize_line(lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("3장 x", "heading"), ("Chapter 4", "heading"), ("Figure 1", "caption"), ('"id": 12', "code"), ("GET /a", "code"), (" ", "paragraph"), ("what if", "code"), ("plain words", "paragraph"), ("a{}b", "code")])
def test_classify_block(spark, raw, want):
    assert value(spark, R.classify_block(lit(raw))) == want


def test_symbol_ratio(spark):
    assert value(spark, R.symbol_ratio(lit("a{}b"))) == 0.5
    assert value(spark, R.symbol_ratio(lit("  "))) == 0.0


def test_geometry(spark):
    box = F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.5).alias("w"), F.lit(0.1).alias("h"))
    got = value(spark, R.pixel_box(box, F.lit(100), F.lit(200)))
    assert [round(v, 6) for v in got] == [10, 140, 60, 160]
    small = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("x1"), F.lit(2000.0).alias("y1"))
    assert list(value(spark, R.point_box(small, F.lit(0), F.lit(1000), F.lit(612.0), F.lit(792.0)))) == [0, 0, 1, 1584]
    assert value(spark, R.render_scale(lit("QUALITY"))) == 3.0 and value(spark, R.render_scale(lit("x"))) == 2.4
    assert list(value(spark, R.page_bounds(F.lit(0), F.lit(0), F.lit(0), F.lit(9)))) == [612.0, 9.0]


def test_tokens(spark):
    assert value(spark, T.number_tokens(lit("a1 b22"))) == ["1", "22"]
    assert value(spark, T.url_tokens(lit("글API.mysite.com see http://x.y/z www.q"))) == ["api.mysite.com", "http://x.y/z", "www.q"]
    assert value(spark, T.union_strings(lit([" a", "b"]), lit(["b", "", "c"]))) == ["a", "b", "c"]
    assert value(spark, T.first_filled(lit(" "), lit(" x "))) == "x"
    assert value(spark, T.match_lines(lit("A b\r\n  C\n\n"))) == ["ab", "c"]


@pytest.mark.parametrize(("done", "total", "want"), [(0, 10, "[----------]"), (10, 10, "[==========]"), (3, 0, "[----------]"), (1, 4, "[===-------]")])
def test_progress_bar(spark, done, total, want):
    assert value(spark, labels.progress_bar(F.lit(done), F.lit(total), 10)) == want


@pytest.mark.parametrize(("seconds", "want"), [(59.6, "01:00"), (3661.0, "01:01:01"), (-4.0, "00:00")])
def test_format_duration(spark, seconds, want):
    assert value(spark, labels.format_duration(F.lit(seconds))) == want


def test_milestones(spark):
    assert value(spark, labels.milestone(F.lit(10), F.lit(100))) == 2 and value(spark, labels.milestone(F.lit(3), F.lit(10))) == 3
    printed = [p for p in range(1, 5) if value(spark, labels.crossed(F.lit(p), F.lit(100), F.lit(p - 1)))]
    assert printed == [1]


def test_labels(spark):
    assert value(spark, labels.counts_label(F.lit(1), F.lit(2), F.lit(3), F.lit(4))) == "ok=1 fail=2 run=3 skip=4"
    assert value(spark, labels.page_label(lit("vision_ocr"), lit("a.pdf"), F.lit(2), F.lit(1), F.lit(5))) == " | ocr a.pdf 1/5 p2"
    assert value(spark, labels.active_label(lit(["a", "b", "c"]), lit(""))) == " | active 3(a,b,+1)"
    assert value(spark, labels.active_label(lit([]), lit("z"))) == " | last z"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('```json\n{"a": {"b": "}"}}\n```', '{"a": {"b": "}"}}'),
        ('x {bad} {"k":1} y', "{bad}"),
        ('{a: 1} tail {"x":2}', "{a: 1}"),
        (" no brace here ", "no brace here"),
        ('say {"a": {"b": 1}', '{"a": {"b": 1}'),
        ('{"a": "\\"}{"} b', '{"a": "\\"}{"}'),
        ('{"open: }', '{"open: }'),
        ("", ""),
        (None, None),
    ],
)
def test_json_object(spark, raw, want):
    assert value(spark, json_text.first_json_object(F.lit(raw).cast("string"))) == want


def brute_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 14))] for _ in range(2))
        script = lines.edit_script(a, b)
        assert lines.common_length(a, b) == brute_common(a, b) == sum(op == "=" for op, _ in script)
        assert [x for op, x in script if op != "+"] == a and [x for op, x in script if op != "-"] == b


def test_active_names(spark):
    events = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(n).alias("name")) for p, n in (("job_started", "a"), ("job_started", "b"), ("job_started", "a"), ("job_done", "c"), ("job_done", "a"), ("job_started", "d"), ("page_done", "z"), ("job_started", ""))])
    assert value(spark, labels.active_names(events)) == ["b", "d"]
    assert value(spark, labels.credential_kind(lit(" "), lit("none"))) == "none" and value(spark, labels.credential_kind(lit(" k "), lit("x"))) == "k" and value(spark, labels.credential_kind(lit(""), lit("model"))) == "unknown"


def test_answer_text(spark):
    assert value(spark, json_text.answer_text(lit('{"choices":[{"message":{"content":"hi"}}]}'))) == "hi"
