"""DataFrame operators on literal cases."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folio import schemas
from folio import api
from folio.functions import lines
from folio.functions import text as T
from folio.operators import bench, correct, evaluate, jobs, model, network, render, shards, telemetry, validate
from folio.plans import config as C
from folio.plans import run as plan
from folio.sources import adapters as A
from folio.sources import documents as D
from folio.streaming import progress

BLOCKS = "source_pdf string, page int, pos int, block_id string, text string, source_text string, block_type string, reading_order int, correction " + schemas.BLOCK_CORRECTION
PAGES = "source_pdf string, page int, width int, height int, is_blank boolean, text string, source_text string, correction " + schemas.PAGE_CORRECTION


def document(spark, *texts, kinds=None, orders=None):
    rows = [("d", 1, i, None, t, None, kinds[i] if kinds else None, orders[i] if orders else None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame([("d", 1, -3, 5, False, None, None, None)], PAGES), spark.createDataFrame(rows, BLOCKS)


def proposal(spark, *items, status=""):
    blocks = [{"block_id": b, "text": t, "reasons": r} for b, t, r in items]
    text = json.dumps({"pages": [{"page": 1, "status": status, "blocks": blocks}, {"page": 9, "blocks": []}]})
    return spark.range(1).select(F.lit("d").alias("source_pdf"), F.from_json(F.lit(text), schemas.PROPOSAL)["pages"].alias("pages"))


def test_unchanged_round_trip(spark):
    pages, blocks = correct.run(*document(spark, "hello world"), None)
    p, b = pages.first(), blocks.first()
    assert (p.text, p.source_text, p.correction.status, p.correction.total_blocks, p.is_blank) == ("hello world", "hello world", "unchanged", 1, False)
    assert (b.block_id, b.correction.status, b.correction.reasons, b.correction.edited, b.block_type) == ("p1-b1", "unchanged", ["no_change"], False, "paragraph")


def test_accepted_correction_keeps_the_page_status(spark):
    pages, blocks = correct.run(*document(spark, "Hcllo world"), lambda b: proposal(spark, ("p1-b1", "Hello world", ["ocr_fix"])))
    p, b = pages.first(), blocks.first()
    assert (b.text, b.correction.status, b.correction.reasons, b.correction.edited) == ("Hello world", "corrected", ["ocr_fix"], True)
    assert (p.text, p.correction.status, p.correction.changed_blocks) == ("Hello world", "unchanged", 1)
    assert model.changed_pages(pages).first().changed_pages == 1


def test_blank_proposal_and_unknown_block(spark):
    _, blocks = correct.run(*document(spark, "Hcllo"), lambda b: proposal(spark, ("p1-b1", "  ", []), ("p1-b7", "x", [])))
    b = blocks.first()
    assert (b.text, b.correction.status, b.correction.reasons) == ("Hcllo", "unchanged", ["no_change"])


def test_rejected_proposal_keeps_the_source(spark):
    _, blocks = correct.run(*document(spark, "page 12"), lambda b: proposal(spark, ("p1-b1", "page 13", ["fix", "fix "])))
    b = blocks.first()
    assert (b.text, b.correction.status, b.correction.edited, b.correction.reasons, b.correction.protected) == ("page 12", "rejected", False, ["fix", "protected_number_sequence"], True)


@pytest.mark.parametrize(
    ("kind", "source", "proposed", "want"),
    [
        ("code", "a", "b", "protected_code_block"),
        ("CODE", "a1", "a2", "protected_code_block"),
        ("paragraph", "page 12", "page 13", "protected_number_sequence"),
        ("paragraph", "api.mysite.com", "api.mysite.org", "protected_url"),
        ("paragraph", "abcd", "abxy", "edit_distance_limit_exceeded"),
        ("paragraph", "abcdefghijklmnopqrst", "abcdefghijklm1opqrst"[:13] + "zzzzzzz", None),
        ("paragraph", "한글은 좋다", "한굴은 좋다", None),
        ("code", " same ", "same", None),
    ],
)
def test_guard(spark, kind, source, proposed, want):
    got = spark.range(1).select(correct.refusal(F.lit(kind), F.lit(source), F.lit(proposed)).alias("v")).first().v
    assert got == want


def test_guard_that_protects_nothing_is_the_default():
    assert correct.Guard(False, False, False, 0.0).resolved() == correct.Guard()


def test_block_numbers_follow_reading_order_then_position(spark):
    _, blocks = document(spark, "two", "one", "three", orders=[2, 1, None])
    got = {r.text: (r.block_id, r.reading_order) for r in model.number_blocks(blocks).collect()}
    assert got == {"one": ("p1-b1", 1), "two": ("p1-b2", 2), "three": ("p1-b3", 3)}


def test_render(spark):
    pages, blocks = correct.run(*document(spark, "T", "x=1", " ", "fig", "body", kinds=["heading", "code", None, "caption", None]), None)
    assert render.markdown(pages, blocks).first().value == "## Page 1\n### T\n```text\nx=1\n```\n*fig*\nbody\n"
    assert render.page_text(pages).first().value == "T\nx=1\nfig\nbody\n"


def test_nested_documents_survive_a_round_trip(spark, tmp_path):
    pages, blocks = correct.run(*document(spark, "a", "b"), None)
    nested = model.nest(pages, blocks, "test")
    nested.write.json(str(tmp_path / "out"))
    again = D.explode_pages(spark.read.schema(schemas.DOCUMENT).json(str(tmp_path / "out")))
    assert again.first().text == "a\nb"
    assert [r.block_id for r in D.explode_blocks(again).orderBy("pos").collect()] == ["p1-b1", "p1-b2"]


def test_page_defaults(spark, tmp_path):
    (tmp_path / "pages.json").write_text('{"pages":[{"text":"  "},{"page":7,"width":-2,"blocks":[{"text":" x "},{"text":""}]}]}')
    docs = D.read_documents(spark, str(tmp_path / "pages.json"))
    got = D.explode_pages(docs).orderBy("pos").collect()
    assert [(p.page, p.width, p.text, p.is_blank) for p in got] == [(1, 0, "", False), (7, 0, "x", False)]
    assert D.page_count(docs).first().pages == 2


GOLD = "source_pdf string, page int, prose_kr string, prose_mixed string, code string, expected_block_types array<string>, reading_order_snippets array<string>"


def test_evaluate(spark):
    gold = spark.createDataFrame([("d", 1, "안녕하세요", None, "a=1\nb=2", ["paragraph"], ["안녕하세요"]), ("d", 2, "abc", None, None, [], None)], GOLD)
    pages = spark.createDataFrame([("d", 1, "안녕하세요")], "source_pdf string, page int, text string")
    blocks = spark.createDataFrame([("d", 1, 0, "a=1", "code"), ("d", 1, 1, "b=3", "code"), ("d", 1, 2, "안녕하세요", " ")], "source_pdf string, page int, pos int, text string, block_type string")
    per = evaluate.per_page(gold, evaluate.predicted(pages, blocks))
    one, two = per.orderBy("page").collect()
    assert (one.prose_cer, one.code_accuracy, one.order_error, one.mixed_cer) == (0.0, 0.5, False, None)
    assert one.layout_f1 == pytest.approx(2 / 3)
    assert two.missing_prediction and two.prose_cer is None
    s = evaluate.summary(per).first()
    assert (s.evaluated_pages, s.missing_pages, s.order_error_ratio, s.prose_cer, s.mixed_cer) == (2, 1, 0.0, 0.0, None)
    assert evaluate.summary(per.where("page = 9")).first().order_error_ratio is None


def test_batches_skip_blank_pages(spark):
    rows = [("d", n, 0, 0, False, "", "" if n == 2 else "x", ("unchanged", 0, 0 if n == 2 else 1, [])) for n in range(1, 5)]
    got = correct.page_batches(spark.createDataFrame(rows, PAGES), 2).collect()
    assert sorted((r.page, r.batch) for r in got) == [(1, 0), (3, 0), (4, 1)]


JOB = "input_pdf string, run_dir string, status string, attempts int, retryable boolean"


def test_resume(spark):
    files = spark.createDataFrame([(f"/in/{c}.pdf", f"/out/{c}") for c in "abcd"], "input_pdf string, run_dir string")
    state = spark.createDataFrame([("/in/a.pdf", "/out/a", "failed", 2, False), ("/in/b.pdf", "/out/b", "succeeded", 1, True), ("/in/z.pdf", "/out/z", "failed", 1, True)], JOB)
    reports = spark.createDataFrame([("/out/b",), ("/out/c",)], "run_dir string")
    got = {r.input_pdf[4]: (r.status, r.attempts, r.retryable) for r in jobs.plan(files, state, reports).collect()}
    assert got == {"a": ("pending", 0, True), "b": ("skipped", 1, False), "c": ("skipped", 0, False), "d": ("pending", 0, True)}


def test_retry_rounds(spark):
    start = spark.createDataFrame([(f"{c}.pdf", c, "pending", 0, True) for c in "abc"], JOB)
    calls = []

    def execute(todo):
        names = sorted(r.input_pdf for r in todo.collect())
        calls.append(names)
        fails = {"a.pdf": "timeout" if len(calls) == 1 else None, "b.pdf": "input must be .pdf"}
        return spark.createDataFrame([(n, fails.get(n)) for n in names], "input_pdf string, error string")

    done = jobs.run(start, execute, retry_failed=2)
    assert calls == [["a.pdf", "b.pdf", "c.pdf"], ["a.pdf"], []]
    assert jobs.report(done).first().asDict() == {"total": 3, "succeeded": 2, "skipped": 0, "failed": 1}
    failed = spark.createDataFrame([("a.pdf", "a", "failed", 1, True)], JOB)
    assert jobs.runnable(failed, 2).count() == 0 and jobs.runnable(failed, 1).count() == 1


def test_job_columns(spark):
    row = spark.range(1).select(
        jobs.run_dir(F.lit("/in/sub/a.b.PDF"), "/in", "/out").alias("a"),
        jobs.run_dir(F.lit("/in/sub/a.pdf"), "/in/sub/a.pdf", "/out/", single=True).alias("b"),
        jobs.effective_workers(F.lit(0), F.lit(3)).alias("c"),
        jobs.retryable(F.lit(None).cast("string")).alias("d"),
    ).first()
    assert tuple(row) == ("/out/sub/a.b", "/out/a", 1, False)


def test_files(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.pdf").write_text("x")
    names = lambda deep: [r.input_pdf.rsplit("/", 1)[1] for r in D.discover_files(spark, str(tmp_path), deep).collect()]
    assert names(False) == ["a.pdf", "b.PDF"] and names(True) == ["a.pdf", "b.PDF", "d.pdf"]


def test_timings(spark):
    t = spark.createDataFrame([("r", 0, {"a": 1.0}), ("r", 1, {"a": 2.0, "b": 3.0})], "run string, seq int, timings map<string,double>")
    as_map = lambda df: {r.key: r.value for r in df.collect()}
    assert as_map(telemetry.merge_last(t)) == {"a": 2.0, "b": 3.0} and as_map(telemetry.merge_sum(t)) == {"a": 3.0, "b": 3.0}
    empty = telemetry.stage_profile(spark.createDataFrame([], schemas.TIMING), F.lit(0.0)).first()
    assert (empty.pages, empty.render_average_seconds, empty.total_parallelism) == (0, 0.0, 0.0)


def test_peak_concurrency(spark):
    spans = [(0, 3600 * 5), (10, 20), (15, 30), (20, 40), (3600 * 3, 3600 * 4)]
    df = spark.createDataFrame(spans, "a long, b long").select(F.timestamp_seconds("a").alias("started_at"), F.timestamp_seconds("b").alias("ended_at"))
    assert telemetry.peak_concurrency(df).first().peak == 3


def test_shards(spark):
    n = spark.createDataFrame([("d", 8), ("e", 2)], "source_pdf string, page_count int")
    assert [(r.source_pdf, r.start, r.pages, r.error) for r in shards.ranges(n, 3).orderBy("source_pdf", "shard").collect()] == [("d", 0, 3, None), ("d", 3, 3, None), ("d", 6, 2, None), ("e", None, None, "3 shards for 2 pages")]
    pages = spark.range(8).select(shards.shard_of(F.col("id"), F.lit(8), 3).alias("s"))
    assert [r.s for r in pages.collect()] == [0, 0, 0, 1, 1, 1, 2, 2]
    with pytest.raises(ValueError):
        shards.check(3, 4)


RUNS = "run_no long, label string, workers int, mode string, elapsed_seconds double, pages_per_minute double, ocr_seconds double, pdf_seconds double"


def test_bench(spark):
    runs = spark.createDataFrame([(1, "w1", 1, "manual", 120.0, 10.0, 80.0, 30.0), (2, "w4", 4, "manual", 60.0, 20.0, 40.0, 15.0)], RUNS)
    text = bench.markdown(bench.relative(runs), "Workers").first().value
    assert "| `w4` | 4 | manual | 60.000 | 20.000 | 40.000 | 15.000 | 2.00x | 2.00x |" in text and text.endswith("- Fastest run: `w4`\n")
    none = bench.relative(runs.withColumn("elapsed_seconds", F.lit(0.0))).first()
    assert none.speedup is None
    assert bench.parse_specs("1, 4, auto", 2) == [("w1", 1, "manual"), ("w4", 4, "manual"), ("auto", 2, "auto")]
    assert [x[0] for x in bench.parse_shard_specs("1, 4", 1)] == ["s1-w1", "s4-w1"] and bench.parse_shard_specs("2", None)[0][0] == "s2-auto"
    for bad in ("", "1,1", "x"):
        with pytest.raises(ValueError):
            bench.parse_specs(bad, 2)
    assert bench.auto_workers(True, 32) == 2 and bench.auto_workers(False, 1) == 1 and bench.auto_workers(False, 32) == 8


def test_validation(spark):
    expected = spark.createDataFrame([(1, "Ab c"), (2, ""), (3, "one\ntwo"), (4, "gone")], "page int, text string")
    found = spark.createDataFrame([(1, "xABCx"), (3, "one")], "page int, found string")
    m = validate.page_matches(expected, found)
    assert [(r.line_ratio, r.expected_filled) for r in m.orderBy("page").collect()] == [(1.0, True), (1.0, False), (0.5, True), (0.0, True)]
    r = validate.rollup(m).first()
    assert (r.pages, r.expected_filled, r.covered, r.mean_ratio, r.min_ratio, r.ok) == (4, 3, 2, 0.5, 0.0, False)
    assert [x.page for x in validate.first_failing(m, 1).collect()] == [3]
    empty = validate.rollup(m.where("page = 9")).first()
    assert (empty.mean_ratio, empty.coverage, empty.ok) == (1.0, 1.0, True)


def test_line_diff(spark):
    assert lines.edit_script(["a", "b"], ["b", "a"]) == [("+", "b"), ("=", "a"), ("-", "b")]
    df = spark.createDataFrame([(1, "a\r\nb\n\n", "a\nc")], "page long, text string, found string")
    assert [(r.op, r.line) for r in validate.line_diff(df).orderBy("seq").collect()] == [("=", "a"), ("+", "c"), ("-", "b")]


@pytest.mark.parametrize(("endpoint", "want"), [("127.0.0.1:80", True), ("localhost:443", True), ("[::1]:443", True), ("1.1.1.1:53", False), ("example.com:443", False), ("127.0.0.999:1", False), ("127.1.2.3", True), ("[0:0:0:0:0:0:0:1]:9", True), ("[::ffff:127.0.0.1]:9", True), ("[::ffff:9.9.9.9]:9", False), ("LOCALHOST:1", True)])
def test_loopback(spark, endpoint, want):
    assert spark.range(1).select(network.is_loopback(F.lit(endpoint)).alias("v")).first().v is want


def test_network(spark):
    s = spark.createDataFrame([(1, "1.1.1.1:53"), (1, "1.1.1.1:53"), (2, "localhost:1"), (3, "")], "pid int, endpoint string")
    v = network.violations(s)
    assert (v.first().samples, v.first().violations) == (4, ["1/1.1.1.1:53"])
    assert network.local_only(v.withColumn("selfcheck_ok", F.lit(True))).first().monitor_ok is False
    tree = spark.createDataFrame([(2, 1), (3, 2), (9, 8), (1, 1), (2, 3)], "pid long, ppid long")  # 2 and 3 below each other
    assert sorted((r.pid, r.depth) for r in network.process_tree(tree, 1).collect()) == [(1, 0), (2, 1), (3, 2)]


def test_progress_lines(spark):
    rows = [('PROGRESS {"phase":"page_done","current_page":2}',), ("PROGRESS {bad",), ("plain",)]
    got = D.parse_progress(spark.createDataFrame(rows, "value string")).collect()
    assert [r.event.current_page if r.event else None for r in got] == [2, None, None]


def test_answer_parts(spark):
    events = {
        "a": ['data: {"delta":"Hel"}', "", "data: {", 'data: "delta":"lo"}', "", "data: [DONE]"],
        "b": ['data: {"response":{"output_text":"whole"},"type":"response.completed"}'],
        "c": ["event: x", 'data: {"type":"response.output_text.delta","delta":"p"}', "", 'data: {"type":"response.output_text.done","text":"q"}'],
    }
    rows = [(k, n, line) for k, all_ in events.items() for n, line in enumerate(all_)]
    got = {r.answer_id: r.text for r in D.join_answer_parts(spark.createDataFrame(rows, "answer_id string, seq int, line string")).collect()}
    assert got == {"a": "Hello", "b": "whole", "c": "pq"}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('PROGRESS {"phase":"p","stage":"s","current_page":1}\nnoise\n')
    out = progress.drain(progress.progress_events(spark, str(tmp_path / "in")), "events")
    assert sorted(r.event.stage if r.event else "-" for r in out.collect()) == ["-", "s"]


EVENTS = "run string, seq long, at double, phase string, stage string, current_page long, completed_pages long, total_pages long"


def test_sparse_progress(spark, tmp_path):
    """The start and the first page are printed, pages 2 to 4 of 100 are not, page 5 is a twentieth."""
    steps = [("r", 0, 0.0, "document_started", "ocr", 0, 0, 100)] + [("r", n, n / 10, "page_done", "ocr", n, n, 100) for n in range(1, 7)]
    steps += [("r", 7, 0.7, "page_started", "ocr", 7, 6, 100), ("r", 8, 6.0, "page_done", "ocr", 7, 7, 100), ("r", 9, 6.1, "page_done", "post", 8, 8, 100)]
    steps += [("s", 0, 0.0, "page_started", "ocr", 1, 0, 5), ("s", 1, 0.1, "tick", "ocr", 1, 0, 0), ("s", 2, 0.2, "tick", "ocr", 1, 0, 0)]
    e = spark.createDataFrame(steps, EVENTS)
    sparse = [("r", 0), ("r", 1), ("r", 5), ("r", 8), ("r", 9), ("s", 1)]
    assert sorted((r.run, r.seq) for r in progress.rendered(e).collect()) == sparse
    live = sorted((r.run, r.seq) for r in progress.rendered(e, live=True).collect())
    assert live == [("r", n) for n in range(10) if n != 7] + [("s", 1)]
    e.write.parquet(str(tmp_path / "e.parquet"))
    streamed = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e.parquet"))
    assert sorted((r.run, r.seq) for r in progress.drain(progress.rendered(streamed), "rendered").collect()) == sparse


def test_the_last_of_repeated_keys_counts(spark):
    gold = spark.createDataFrame([("d", 1, "good text", None, "a=1", ["code"], None)], GOLD)
    pages = spark.createDataFrame([("d", 1, 3, "good text"), ("d", 1, 2, "bad")], "source_pdf string, page int, page_pos int, text string")
    blocks = spark.createDataFrame([("d", 1, 3, 0, "a=1", "code"), ("d", 1, 2, 0, "x", "heading")], "source_pdf string, page int, page_pos int, pos int, text string, block_type string")
    per = evaluate.per_page(gold, evaluate.predicted(pages, blocks))
    assert evaluate.summary(per).first().evaluated_pages == 1
    one = per.first()
    assert (one.prose_cer, one.code_accuracy, one.layout_f1) == (0.0, 1.0, 1.0)

    _, out = correct.run(*document(spark, "Hcllo world"), lambda b: proposal(spark, ("p1-b1", "Hcllo worlds", ["first"]), ("p1-b1", "Hello world", ["second"])))
    assert [(b.text, b.correction.reasons) for b in out.collect()] == [("Hello world", ["second"])]
    same = document(spark, "Hcllo", "Hcllo")
    twins = same[0], same[1].withColumn("block_id", F.lit("x"))
    _, out = correct.run(*twins, lambda b: proposal(spark, ("x", "Hello", [])))
    assert [b.text for b in out.orderBy("pos").collect()] == ["Hcllo", "Hello"]
    answers = [{"page": 1, "status": "corrected", "notes": ["n"], "blocks": []}, {"page": 1, "status": "", "blocks": []}]
    page = spark.range(1).select(F.lit("d").alias("source_pdf"), F.from_json(F.lit(json.dumps({"pages": answers})), schemas.PROPOSAL)["pages"].alias("pages"))
    pages, _ = correct.run(*document(spark, "a"), lambda b: page)
    assert [(p.correction.status, p.correction.notes) for p in pages.collect()] == [("corrected", ["n"])]

    files = spark.createDataFrame([("/in/a.pdf", "/out/a")], "input_pdf string, run_dir string")
    state = spark.createDataFrame([("/in/a.pdf", "/out/a", "succeeded", 2, True, 1), ("/in/a.pdf", "/out/a", "failed", 9, True, 0)], JOB + ", seq int")
    got = jobs.plan(files, state, spark.createDataFrame([("/out/a",)], "run_dir string")).collect()
    assert [(r.status, r.attempts) for r in got] == [("skipped", 2)]


def test_word_bound_and_edit_distance_agree(spark):
    pairs = [("the cat sat on it", "the cot sat on it"), ("a b c d", "a x y z"), ("one two", "one two three four"), ("shifted by one word", "now shifted by one word"), ("abcdefghij", "abcdefgxyz"), ("", "x")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = rows.select("a", "b", correct.refusal(F.lit("paragraph"), F.col("a"), F.col("b")).alias("why"), F.levenshtein("a", "b").alias("d")).collect()
    assert all((r.why is None) == (r.a == "" or r.d <= 0.35 * len(r.a)) for r in got)


def test_config():
    base = C.Profile(provider="model", auth_ref="k", model="m", temperature=0.7)
    config = C.Config(credentials={"k": "token"}, profiles={"p": base}, runtime_profile="p", runtime_override=C.Override(mode="primary_artifacts", timeout_seconds=90, temperature=0.0))
    got = C.resolve(config)
    assert (got.provider, got.mode, got.timeout_seconds, got.temperature) == ("model", "primary_artifacts", 90, 0.0)
    assert C.resolve(config, "none").provider == "none" and C.resolve(config, "none").model == "m"
    with pytest.raises(ValueError):
        C.resolve(C.Config(profiles={"p": C.Profile(), "q": C.Profile()}))
    with pytest.raises(ValueError):
        C.resolve(C.Config(version="v9"))
    with pytest.raises(ValueError):
        C.resolve(C.Config(profiles={"p": C.Profile(auth_ref="?")}))
    with pytest.raises(PermissionError, match="flag"):
        C.allow_remote(config, got, False)
    with pytest.raises(PermissionError, match="config"):
        C.allow_remote(C.Config(allow_remote=False), got, True)
    assert C.output_mode("primary_artifacts", False)[0] == "sidecar"
    with pytest.raises(ValueError):
        C.check_run("x", workers=0)


def test_run_plan(spark, tmp_path):
    lines = spark.createDataFrame([("d", 1, 0, "second", 5.0, 0.0), ("d", 1, 1, " 3강 ", 1.0, 0.0), ("d", 1, 2, "  ", 0.0, 0.0)], "source_pdf string, page int, pos int, text string, y0 double, x0 double")
    result = plan.run(lines)
    assert result.text.first().value == "3장\nsecond\n"
    assert result.markdown.first().value.startswith("## Page 1\n### 3장\nsecond")
    plan.write(result, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "blocks")).count() == 2


def test_adapters_cover_every_document(spark):
    pages = A.document_pages(spark, "/root/testdata/sf0.001")
    assert pages.count() == pages.select("source_pdf", "page").distinct().count()
    assert A.document_blocks(pages).where(T.blank(F.col("text"))).count() == 0


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"source_pdf":"d","pages":[{"page":"x","text":"t","blocks":[{"text":"b"}]},{"page":2,"text":"u"}]}')
    (tmp_path / "q.json").write_text('{"source_pdf":"e"}')
    assert [json.loads(p)["page"] for p in D.read_raw_documents(spark, str(tmp_path / "p.json")).first().pages] == ["x", 2]
    tolerant = D.explode_pages(D.read_tolerant_documents(spark, str(tmp_path / "p.json"))).orderBy("pos").collect()
    assert [p.page for p in tolerant][1] == 2 and len(tolerant) == 2
    assert D.explode_pages(D.read_documents(spark, str(tmp_path / "q.json")), keep_empty=True).count() == 1
    report = spark.createDataFrame([("e", "a.pdf", "none", 30.0, 2, {"ocr_seconds": 4.0}, ["w"])], schemas.REPORT)
    D.write_json(report, str(tmp_path / "report"), indent=True)
    assert D.read_json_rows(spark, str(tmp_path / "report"), schemas.REPORT, indent=True).first() == report.first()
    s = D.run_summary(report).first()
    assert (s.pages_per_minute, s.ocr_seconds, s.pdf_seconds) == (4.0, 4.0, 0.0)
    assert report.select(D.has_warning(F.col("warnings"), "w").alias("v")).first().v
    c = correct.request_counters(spark.createDataFrame([("d", 2, 1.5), ("d", 1, 0.5)], "source_pdf string, pages int, seconds double")).first()
    assert (c.requests, c.request_seconds, c.completed_pages) == (2, 2.0, 3)


def test_artifact_pages(spark):
    pages = spark.createDataFrame([("d", 1, 100, 200), ("d", 2, 0, 0), ("d", 3, 50, 60)], "source_pdf string, page int, width int, height int")
    bounds = spark.createDataFrame([("d", 1, 300.0, 400.0)], "source_pdf string, page int, source_width double, source_height double")
    got = [tuple(r)[2:] for r in model.artifact_pages(pages, bounds).orderBy("page").collect()]
    missing = "corrected_page_missing_source_bounds_%d"
    assert got == [(300.0, 400.0, 300, 400, None), (612.0, 792.0, 612, 792, missing % 2), (50.0, 60.0, 50, 60, missing % 3)]


def test_run_api(spark, tmp_path):
    from folio.plans.recognizer import FixedRecognizer, LineRecognizer

    files = spark.createDataFrame([("/in/a.pdf",), ("/in/b.PDF",)], "input_pdf string")
    seen = []
    fix = lambda b: b.groupBy("source_pdf").agg(F.array(F.struct(F.lit(1).alias("page"), F.lit("").alias("status"), F.lit(None).cast("array<string>").alias("notes"), F.array(F.struct(F.lit("p1-b1").alias("block_id"), F.lit("Hello world").alias("text"), F.lit("").alias("status"), F.lit(None).cast("array<string>").alias("reasons"), F.lit(False).alias("protected"), F.lit(None).cast("array<string>").alias("notes"))).alias("blocks"))).alias("pages"))
    done = api.run(files, FixedRecognizer(("Hcllo world",)), fix, C.Profile(provider="table", mode="primary_artifacts"), progress=lambda *x: seen.append(x[0]))
    assert {r.value for r in done.result.text.collect()} == {"Hello world\n"} and seen[:2] == ["document_started", "document_done"]
    report = done.report.orderBy("input_pdf").collect()
    assert [(r.pages, r.changed_pages, r.output_mode, r.warnings) for r in report] == [(1, 1, "primary_artifacts", [])] * 2
    lines_ = spark.createDataFrame([("/in/a.pdf", 1, 0, "text", 0.0, 0.0)], "source_pdf string, page int, pos int, text string, y0 double, x0 double")
    side = api.run(files, LineRecognizer(lines_), profile=C.Profile(mode="primary_artifacts"))
    assert [(r.output_mode, r.warnings) for r in side.report.collect()] == [("sidecar", ["primary_artifacts_not_supported_by_provider"])] * 2  # the second file has no lines
    leak = spark.createDataFrame([(1, "1.1.1.1:53")], "pid long, endpoint string")
    with pytest.raises(api.LocalOnlyViolation) as e:
        api.run(files, FixedRecognizer(samples=leak), local_only=True)
    assert e.value.report.first().violations == ["1/1.1.1.1:53"]
    assert api.run(files, FixedRecognizer(samples=leak)).local_only.first().monitor_ok is False
    with pytest.raises(ValueError, match="must be .pdf"):
        api.run(spark.createDataFrame([("/in/a.txt",)], "input_pdf string"), FixedRecognizer())
    with pytest.raises(PermissionError):
        api.run(files, FixedRecognizer(), profile=C.Profile(provider="model"))
    assert api.selfcheck(spark)
    api.save(done, f"file://{tmp_path}/saved")
    assert D.read_json_rows(spark, f"file://{tmp_path}/saved/run_report", schemas.REPORT, indent=True).count() == 2


def test_batch_api(spark, tmp_path):
    from folio.plans.recognizer import FixedRecognizer

    for name in ("a.pdf", "b.pdf"):
        (tmp_path / name).write_text("x")
    where = str(tmp_path)
    done, report = api.batch(spark, where, f"{where}/out", FixedRecognizer())
    assert {r.status for r in done.collect()} == {"succeeded"} and report.first().succeeded == 2
    assert spark.read.parquet(f"{where}/out/round-0/pages").count() == 2
    again, report = api.batch(spark, where, f"{where}/out", FixedRecognizer(), state=done, reports=done.where("input_pdf like '%a.pdf'").select("run_dir"))
    assert report.first().asDict() == {"total": 2, "succeeded": 1, "skipped": 1, "failed": 0}

    class Broken(FixedRecognizer):
        def recognize(self, *a, **b):
            raise RuntimeError("timeout")

    failed, report = api.batch(spark, f"{where}/a.pdf", f"{where}/out2", Broken(), retry_failed=1)
    assert [(r.status, r.attempts) for r in failed.collect()] == [("failed", 2)]
    with pytest.raises(ValueError, match="no .pdf"):
        api.batch(spark, str(tmp_path / "out"), where, FixedRecognizer())


def test_evaluation_api(spark, tmp_path):
    (tmp_path / "gold.json").write_text('{"version":"1","source_pdf":"d","pages":[{"page":1,"prose_kr":"abc","code":"a=1"},{"page":2,"prose_kr":"x"}]}')
    (tmp_path / "pred.json").write_text('{"source_pdf":"d","pages":[{"page":1,"text":"bad"},{"page":1,"text":"abc","blocks":[{"text":"a=1","block_type":"code"}]}]}')
    got = api.evaluation(spark, str(tmp_path / "gold.json"), str(tmp_path / "pred.json"), str(tmp_path / "out")).first()
    assert (got.summary.evaluated_pages, got.summary.missing_pages, got.summary.prose_cer, got.summary.code_accuracy) == (2, 1, 0.0, 1.0)
    assert got.per_page[2].missing_prediction and got.per_page[1].prose_cer == 0.0


def test_validation_api(spark, tmp_path):
    expected = spark.createDataFrame([(1, "Ab c"), (2, "one\ntwo")], "page long, text string")
    found = spark.createDataFrame([(1, "xABCx"), (2, "one")], "page long, found string")
    ok, report = api.validation(expected, found, f"file://{tmp_path}/v")
    assert not ok and report.first().covered == 2
    dump = D.read_json_rows(spark, f"file://{tmp_path}/v/failing", "page long, expected string, extracted string, value string", indent=True).first()
    assert (dump.page, dump.expected, dump.extracted) == (2, "one\ntwo", "one") and dump.value.endswith(" one\n-two\n")
    assert api.validation(expected.where("page = 1"), found)[0]


def test_benchmark_api(spark, tmp_path):
    calls = []

    def execute(label, workers, mode):
        calls.append(label)
        return {"pages": 20, "elapsed_seconds": 120.0 / workers, "ocr_seconds": 1.0, "pdf_seconds": 0.5}

    where = f"file://{tmp_path}/b"
    for specs in ([("w1", 1, "manual")], [("w1", 1, "manual"), ("w4", 4, "manual")]):
        runs = {r.label: r for r in api.benchmark(spark, specs, execute, where).collect()}
    assert calls == ["w1", "w4"] and runs["w4"].speedup == 4.0 and runs["w1"].pages_per_minute == 10.0
    assert "- Fastest run: `w4`" in "\n".join(r.value for r in spark.read.text(f"{where}/summary_markdown").collect())


def test_config_file_and_environment(tmp_path):
    raw = {"version": "v1alpha1", "profiles": {"p": {"provider": "table", "timeout_seconds": 0, "guard": {"code_blocks": False, "numbers": False, "urls": False, "max_edit_ratio": 0}}}, "runtime_override": {"model": "m"}}
    (tmp_path / "c.json").write_text(json.dumps(raw))
    config = C.load(environ={C.CONFIG_VARIABLE: str(tmp_path / "c.json")})
    got = C.with_defaults(C.resolve(config), {C.TIMEOUT_VARIABLE: "7"})
    assert (got.provider, got.model, got.timeout_seconds, got.guard) == ("table", "m", 7, correct.Guard())
    assert C.load(environ={}) == C.Config() and C.with_defaults(C.Profile(timeout_seconds=0), {}).timeout_seconds == C.DEFAULT_TIMEOUT


def test_kept_tables_are_cleaned_and_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from folio import session

    monkeypatch.setattr(session, "_made", {})
    table = session.keep(spark.range(3), "some")
    assert table.count() == 3 and session.clean(spark) == 1
    with pytest.raises(Exception, match="(?i)not.exist|no such file|not found"):
        spark.read.parquet(table.inputFiles()[0]).count()
    bare = SimpleNamespace(sparkContext=SimpleNamespace(getConf=dict, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.work_dir(bare)


def test_figures_are_rounded_and_printed_as_sql_does(spark):
    # Ties of the shortest decimal text that the double itself does not have, true ties, signs, tiny and large values.
    r = random.Random(3)
    xs = [4.6095, 0.125, 0.375, 2.5, 1.005, 0.0, -0.0, -0.0004, 0.0005, 1e-9, 0.9995, 123456789.0625, 2.0**52 + 1, 4.5e15, 9e14 + 0.125, -1.0005]
    xs += [round(r.uniform(0, 10 ** r.randint(0, 9)), 4) for _ in range(400)] + [r.randint(0, 10**9) / 400 for _ in range(400)] + [r.uniform(0, 1e6) for _ in range(200)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", T.fixed(F.col("x"), 3).alias("three"), T.fixed(F.col("x"), 2).alias("two"), T.rounded(F.col("x"), 3).alias("r")).collect()
    con = duckdb.connect()
    for g in got:
        assert (g.three, g.two) == ("%.3f" % g.x, "%.2f" % g.x)
        assert g.r == con.execute("SELECT round(?::DOUBLE, 3)", [g.x]).fetchone()[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_benchmark_tables_match_their_sql_on_ties(spark, tmp_path, seed):
    from folio.plans import catalog

    # Odd cents: a quarter of each total is a tie at three digits, and throughputs at four digits often are one too.
    r = random.Random(seed)
    rows = [(k, r.randint(0, 50), f"type{k % 40:02}", r.randint(1, 10**6) / 100) for k in range(2000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("bench_markdown", "bench_document", "bench_shard_document"):
        assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.execute(catalog.ORACLE_SQL[name]).fetchall()), name


def test_code_line_accuracy_matches_its_sql(spark, tmp_path):
    from folio.plans import catalog

    # Pages without lines or a source, other line ends and spaces, marks, numbers and letters around words, and a tie at six digits: 323 of 640.
    texts = ["", None, " \n\t\n", "x", "a\n\n\x85", "if x\n\x0b\nb \x0b", "a \u2028\nfor y", "cla\u017f\u017f A\nx", "if\u0301 x\ny", "\u0301for x\ny", "if\u00b2 x\ny", "\u2167if x\ny", "\U0001d487if x\ny", "\U0001f600if x\ny", "3\x0b\uc7a5\nif x"]
    texts.append("\n".join(f"if {k} {{ }}" if k % 2 == 0 or k in (1, 3, 5) else f"prose {k}" for k in range(640)))
    rows = [(doc, "s", text) for k, text in enumerate(texts) for doc in (7 * k, 7 * k + 1)] + [(700, None, "if x")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = (sorted(map(tuple, x)) for x in (catalog.QUERIES["code_line_accuracy"](spark, str(tmp_path)).collect(), con.execute(catalog.ORACLE_SQL["code_line_accuracy"]).fetchall()))
    assert got == want
    assert len(got) == 2 * (len(texts) - 3)
