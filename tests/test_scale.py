"""Documents of any size, ordered output, failures by file, saved state, state machines and batch progress."""

import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio import api, schemas
from folio.functions import json_text, lines, nearest
from folio.operators import bench, correct, jobs, network, order, render, telemetry, validate
from folio.plans import config as C
from folio.plans.recognizer import CallRecognizer, FixedRecognizer, LineRecognizer
from folio.sources import documents as D
from folio.sources import pages as P
from folio.streaming import machine, progress
from folio.streaming.state import SavedState


def lit(x):
    return F.lit(x).cast("string")


# ---- documents of any size


def nasty(n, seed=1):
    """A document whose strings hold quotes, braces and backslashes, with other arrays before and after its pages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(['"', "\\", "}", "{", "]", "[", ",", "a", "é", "\n", " ", '"pages": [', "}}"]) for _ in range(r.randint(0, 12)))
    pages = [{"page": k + 1, "width": 7, "is_blank": False, "text": word(), "source_text": word(), "blocks": [{"block_id": f"b{j}", "text": word(), "bbox": {"x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0}} for j in range(r.randint(0, 3))]} for k in range(n)]
    return {"engine": "e" + word(), "meta": {"pages": [{"page": 99}], "list": [[1, {"x": "}"}], "],["]}, "list": [{"page": 5}, "\"pages\":["], "source_pdf": f"d{seed}" + word(), "pages": pages, "after": [[{"page": 3}], "x}"], "end": "]}"}


@pytest.mark.parametrize("separator,indent,size", [("}", None, 700), ("}", 1, 300), ("\n", 2, 500), ("}", None, 1 << 20)])
def test_large_documents_read_like_others(spark, tmp_path, separator, indent, size):
    docs = [nasty(60, 1), nasty(1, 2), nasty(0, 3), {"source_pdf": "none"}, {"source_pdf": "null", "pages": None}, {"source_pdf": "gaps", "pages": [None, {"page": 2, "text": "t"}, {}]}]
    for k, d in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(json.dumps(d, ensure_ascii=k % 2 == 0, indent=indent) + "\n" * (k % 3))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        for keep_empty in (False, True):
            got = sorted(map(str, P.read_pages(spark, str(tmp_path), keep_empty, separator).collect()))
            assert got == sorted(map(str, D.explode_pages(D.read_documents(spark, str(tmp_path)), keep_empty).collect()))
        if size < 1000:
            assert spark.read.option("lineSep", separator).text(str(tmp_path / "0.json")).rdd.getNumPartitions() > 3
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


@pytest.mark.parametrize("separator", ["}", "\n"])
def test_batches_are_scanned_in_bounded_pieces(separator):
    # One Arrow batch of 64 MB took 2.4 GB in a Python worker.
    batch = pa.record_batch([pa.array(["f"] * 6000), pa.array([""] * 6000), pa.array([0] * 6000, pa.int64()), pa.array(["x" * 1000] * 5999 + ["y" * (3 << 20)])], ["file", "part", "block", "value"])
    sizes = [len(buf) for *_, buf in P._pieces(iter([batch]), separator.encode())]
    assert sum(sizes) == 5999 * 1001 + (3 << 20) + 1 and sizes[-1] == (3 << 20) + 1 and max(sizes[:-1]) <= P.PIECE_BYTES + 3000


def test_a_hundred_thousand_pages_in_one_file(spark, tmp_path):
    with open(tmp_path / "big.json", "w") as f:
        f.write('{"engine":"e","source_pdf":"big","pages":[' + ",".join('{"page":%d,"text":"page } \\" %d","blocks":[{"text":"t%d"}]}' % (k + 1, k, k) for k in range(100_000)) + "]}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        got = P.read_pages(spark, str(tmp_path / "big.json"))
        row = got.agg(F.count("*"), F.count_distinct("pos"), F.sum("page"), F.count_if(F.col("text") == F.format_string('page } " %d', F.col("page") - 1)), F.sum(F.size("blocks"))).first()
        assert tuple(row) == (100_000, 100_000, 100_000 * 100_001 // 2, 100_000, 100_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_large_documents_are_written_in_order_and_read_back(spark, tmp_path):
    rows = [(d, k, f'text "{k}"\n}}', [(f"l{k}",)]) for d, n in (("a", 70), ("b é/1", 1)) for k in range(1, n + 1)]
    pages = spark.createDataFrame(rows, "source_pdf string, page int, text string, blocks array<struct<text:string>>").repartition(5)
    D.write_large_documents(pages, "me", str(tmp_path / "out"))
    back = P.read_pages(spark, str(tmp_path / "out"), separator="\n", folders=True)
    assert sorted((r.source_pdf, r.pos + 1, r.page, r.text) for r in back.collect()) == sorted((d, k, k, t) for d, k, t, _ in rows)
    parts = sorted((tmp_path / "out" / "folder=a").glob("part-*"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert [p["page"] for p in whole["pages"]] == list(range(1, 71)) and whole["engine"] == "me"


def test_text_and_markdown_in_ordered_files(spark, tmp_path):
    pages = spark.createDataFrame([(d, k, f" text {k}\n" if k % 3 else " ") for d in ("a", "b") for k in range(1, 60)], "source_pdf string, page int, text string").repartition(4)
    blocks = spark.createDataFrame([(d, k, 1, f"b{k}", "heading" if k % 2 else "code") for d in ("a", "b") for k in range(1, 60) if k % 3], "source_pdf string, page int, n int, text string, block_type string")
    render.write_text(pages, str(tmp_path / "t"))
    render.write_markdown(pages, blocks, str(tmp_path / "m"))
    for kind, want in (("t", render.page_text(pages)), ("m", render.markdown(pages, blocks))):
        for r in want.collect():
            files = sorted((tmp_path / kind / f"source_pdf={r.source_pdf}").glob("part-*"))
            assert "".join(p.read_text() for p in files).rstrip("\n") == r.value.rstrip("\n")
    text = {r.source_pdf: r.value for r in render.page_text(pages).collect()}
    for r in render.text_layout(pages).collect():
        assert text[r.source_pdf][r.start : r.start + r.size] == (f"text {r.page}" if r.page % 3 else "")


def test_numbers_and_running_totals(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.randint(0, 30), r.randint(-5, 5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    by = {g: sorted(o for h, o, _ in rows if h == g) for g in ("a", "b", None)}
    got = order.numbered(df, ["g"], ["o"]).collect()
    for g, want in by.items():
        assert [x.o for x in sorted((x for x in got if x.g == g), key=lambda x: x["index"])] == want
        assert sorted(x["index"] for x in got if x.g == g) == list(range(len(want)))
    unique = spark.createDataFrame([(k % 2, k, k * k) for k in range(100)], "g int, o int, v int").repartition(6)
    total = {(x.g, x.o): x.s for x in order.running(unique, ["g"], ["o"], s=F.col("v")).collect()}
    assert all(s == sum(j * j for j in range(k + 1) if j % 2 == g) for (g, k), s in total.items()) and len(total) == 100


def test_page_batches_of_one_large_document(spark):
    pages = spark.range(50_000).select(F.lit("d").alias("source_pdf"), (F.col("id") + 1).alias("page"), F.lit("t").alias("source_text"), F.struct(F.lit(1).alias("total_blocks")).alias("correction"))
    assert correct.page_batches(pages, 7).where(F.col("batch") != F.floor((F.col("page") - 1) / 7)).isEmpty()


# ---- kernels


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("group", [1024, 3])
def test_snippet_errors(monkeypatch, group):
    monkeypatch.setattr(nearest, "GROUP", group)
    r = random.Random(2)
    asked, pages = [], []
    for _ in range(150):
        s = "".join(r.choice("abé 가") for _ in range(r.choice([1, 3, 20, 63, 64, 65, 128, 150]))).strip() or "a"
        found = ["".join(r.choice(["", c, c, c, c, "x", c + "b"]) for c in s) for _ in range(r.randint(0, 5))]
        asked.append([s, None, "", s[::-1]])
        pages.append("\n".join(found))
    got = nearest.snippet_errors([*asked, None, ["x"]], [*pages, "p", None])
    assert got[-2:] == [None, [None]]
    for (s, _, _, t), page, e in zip(asked, pages, got, strict=False):
        for x, error in ((s, e[0]), (t, e[3])):
            stripped = [y for y in (line.strip(nearest.EDGE) for line in page.split("\n")) if y]
            want = 1.0 if page == "" else 0.0 if x in page else min([1.0, *(brute_distance(x, y) / len(x) for y in stripped)])
            assert error == pytest.approx(want)
        assert e[1] is None and e[2] == 0.0


def brute_script(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while (i, j) != (len(a), len(b)):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("=", a[i]))
            i, j = i + 1, j + 1
        elif i == len(a) or (j < len(b) and best[i][j + 1] >= best[i + 1][j]):
            out.append(("+", b[j]))
            j += 1
        else:
            out.append(("-", a[i]))
            i += 1
    return out, best[0][0]


def test_edit_scripts():
    r = random.Random(3)
    for _ in range(400):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 14))] for _ in range(2))
        want, size = brute_script(a, b)
        assert lines.edit_script(a, b) == want and lines.common_length(a, b) == size


def test_an_edit_script_of_many_lines_takes_little_memory():
    import tracemalloc

    r = random.Random(4)
    a = [f"line {r.randrange(9000)}" for _ in range(20_000)]
    b = [x if r.random() > 0.3 else f"new {r.randrange(9000)}" for x in a]
    tracemalloc.start()
    got = lines.edit_script(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6 and [x for op, x in got if op != "+"] == a and [x for op, x in got if op != "-"] == b


def test_found_lines():
    assert validate.found_lines(["ab", "b", "ab", "zz", "abab"], "xababx") == 4
    assert validate.found_lines([], "x") == 0 and validate.found_lines(["a"], "") == 0
    r = random.Random(6)
    for _ in range(200):
        asked = ["".join(r.choices("ab", k=r.randint(1, 5))) for _ in range(6)]
        key = "".join(r.choices("ab", k=r.randint(0, 12)))
        assert validate.found_lines(asked, key) == sum(x in key for x in asked)


def test_process_trees(spark):
    chain = spark.range(1, 10_000).select(F.col("id").alias("pid"), (F.col("id") - 1).alias("ppid"))
    done = network.process_tree(chain.unionByName(spark.createDataFrame([(20_001, 20_002), (20_002, 20_001), (7, 7)], "pid long, ppid long")), 0)
    assert done.agg(F.count("*"), F.count_if(F.col("depth") == F.col("pid"))).first()[:] == (10_000, 10_000)
    r = random.Random(7)
    edges = [(r.randrange(1, 40), r.randrange(40)) for _ in range(70)] + [(100 + k, 99 + k) for k in range(5)] + [(99, 3), (0, 5)]
    depth, now = {0: 0}, {0}
    while now:
        now = {p for p, q in edges if q in now and p not in depth}
        depth |= {p: max(depth.values()) + 1 for p in now}
    assert {x.pid: x.depth for x in network.process_tree(spark.createDataFrame(edges, "pid long, ppid long"), 0).collect()} == depth


def test_child_pids(spark):
    rows = spark.createDataFrame([(" 12 ",), ("x1",), ("",), (None,), ("7",)], "line string")
    assert [r.p for r in rows.select(network.child_pids(F.col("line")).alias("p")).collect()] == [12, None, None, None, 7]


# ---- answers


@pytest.mark.parametrize(
    "payload,want",
    [
        ({"output_text": " whole ", "choices": [{"message": {"content": "c"}}]}, " whole "),
        ({"output": [{"content": "O1"}], "choices": [{"message": {"content": "c"}}]}, "c"),
        ({"output": [{"content": [{"text": "O1"}, {"text": "O2"}]}, {"content": "S"}]}, "O1\nO2\nS"),
        ({"output": [{"content": ["a", {"value": "v"}, {"text": 1, "value": "w"}, 3]}, {"content": " "}, 5, {}]}, "a\nv\nw"),
        ({"output_text": 5, "choices": [{}], "output": "x"}, None),
        ([], None),
    ],
)
def test_answer_shapes(spark, payload, want):
    assert spark.range(1).select(json_text.answer_text(lit(json.dumps(payload))).alias("a")).first().a == want


# ---- runs and batches

LINES = "source_pdf string, page int, pos int, text string, y0 double, x0 double"


def test_files_and_pages_without_lines_are_reported(spark):
    files = spark.createDataFrame([("/a.pdf",), ("/b.pdf",)], "input_pdf string")
    found = spark.createDataFrame([("/a.pdf", 1, 0, "text", 0.0, 0.0)], LINES)
    pages = spark.createDataFrame([("/a.pdf", 1), ("/a.pdf", 2)], "source_pdf string, page int")
    done = api.run(files, LineRecognizer(found, pages=pages))
    assert sorted((r.input_pdf, r.pages) for r in done.report.collect()) == [("/a.pdf", 2), ("/b.pdf", 0)]
    assert [(p.page, p.is_blank) for p in done.result.pages.orderBy("page").collect()] == [(1, False), (2, True)]
    assert done.result.text.first().value == "text\n\n\n"


def test_a_bad_file_fails_alone(spark, tmp_path):
    def reads(path):  # sent to the workers by value
        if path.endswith("bad.pdf"):
            raise RuntimeError("no pages: timeout")
        if path.endswith("final.pdf"):
            raise OSError("file not accessible")
        return [(1, "read " + path[-5], 0.0, 0.0), (2, None, 0.0, 0.0)]

    for name in ("a.pdf", "bad.pdf", "c.pdf", "final.pdf"):
        (tmp_path / name).write_text("x")
    out = f"file://{tmp_path}/out"
    done, report = api.batch(spark, str(tmp_path), out, CallRecognizer(reads), retry_failed=1)
    got = {r.input_pdf.rsplit("/", 1)[1]: (r.status, r.attempts, r.retryable, r.error) for r in done.collect()}
    assert got == {"a.pdf": ("succeeded", 1, False, None), "c.pdf": ("succeeded", 1, False, None), "bad.pdf": ("failed", 2, True, "no pages: timeout"), "final.pdf": ("failed", 1, False, "file not accessible")}
    assert report.first().asDict() == {"total": 4, "succeeded": 2, "skipped": 0, "failed": 2}
    saved = SavedState(spark, f"{out}/state")
    assert {r.status for r in saved.load().collect()} == {"succeeded", "failed"}
    # Taken up again from the saved state: what succeeded is skipped.
    again, report = api.batch(spark, str(tmp_path), out, CallRecognizer(lambda p: [(1, "now", 0.0, 0.0)]))
    assert report.first().asDict() == {"total": 4, "succeeded": 2, "skipped": 2, "failed": 0}
    with pytest.raises(RuntimeError, match="bad.pdf: no pages"):
        api.run(spark.createDataFrame([("/bad.pdf",)], "input_pdf string"), CallRecognizer(reads))


def test_a_violation_fails_its_file_alone(spark, tmp_path):
    for name in ("a.pdf", "b.pdf", "c.pdf"):
        (tmp_path / name).write_text("x")
    leak = spark.createDataFrame([(f"file:{tmp_path}/b.pdf", 1, "1.1.1.1:53"), (f"file:{tmp_path}/a.pdf", 1, "127.0.0.1:53")], "input_pdf string, pid long, endpoint string")
    done, _ = api.batch(spark, str(tmp_path), f"{tmp_path}/out", FixedRecognizer(samples=leak), local_only=True)
    assert {r.input_pdf[-5:]: (r.status, r.error) for r in done.collect()} == {"a.pdf": ("succeeded", None), "b.pdf": ("failed", api.VIOLATION), "c.pdf": ("succeeded", None)}
    done, _ = api.batch(spark, str(tmp_path), f"{tmp_path}/out2", FixedRecognizer(samples=leak.drop("input_pdf")), local_only=True)
    assert {r.status for r in done.collect()} == {"failed"}


def test_sidecars(spark, tmp_path):
    files = spark.createDataFrame([("/in/a.pdf",)], "input_pdf string")
    done = api.run(files, FixedRecognizer(("line",)), profile=C.Profile(model="m"))
    api.save(done, f"file://{tmp_path}/saved")
    got = D.read_json_rows(spark, f"file://{tmp_path}/saved/sidecar", "version string, kind string, engine string, source_pdf string, generated_at string, source_artifacts map<string,string>, postprocess struct<provider:string,applied:boolean,output_mode:string,credential_kind:string,model:string,stage_timings:map<string,double>>", indent=True).first()
    assert (got.version, got.kind, got.engine, got.source_pdf) == ("1", "corrected_document", "fixed", "/in/a.pdf") and got.generated_at.endswith("Z")
    assert (got.postprocess.provider, got.postprocess.applied, got.postprocess.credential_kind, got.postprocess.model) == ("none", False, "none", "m")
    folder = got.source_artifacts["text_path"].removeprefix("file://")
    assert [p.read_text() for p in __import__("pathlib").Path(folder).rglob("part-*")] == ["line\n"]


def test_every_change_of_a_batch_is_told(spark):
    told = []
    table = spark.createDataFrame([("a", "/a", "pending", 0, True), ("b", "/b", "skipped", 1, True)], "input_pdf string, run_dir string, status string, attempts int, retryable boolean")
    fail = lambda todo: todo.select("input_pdf", F.lit("timeout").alias("error"))
    jobs.run(table, fail, 1, lambda t: told.append(sorted((r.input_pdf, r.status, r.attempts) for r in t.collect())))
    assert [x[0] for x in told] == [("a", "pending", 0), ("a", "running", 0), ("a", "failed", 1), ("a", "running", 1), ("a", "failed", 2)]
    assert all(x[1] == ("b", "skipped", 1) for x in told)


def test_saved_state_is_whole(spark, tmp_path):
    saved = SavedState(spark, f"file://{tmp_path}/s", retain=2)
    assert saved.load() is None
    one = spark.createDataFrame([("a", 1)], "k string, seq long")
    assert saved.save(one) == 0
    # Killed on the way: the data of the next version is there, half of it, and no mark.
    one.write.parquet(f"file://{tmp_path}/s/versions/1")
    next((tmp_path / "s" / "versions" / "1").glob("part-*")).write_text("torn")
    assert saved.load().collect() == one.collect()
    assert saved.save(one.withColumn("seq", F.lit(2).cast("long"))) == 1 and saved.load().first().seq == 2
    assert saved.save(one, 1) == 1 and saved.load().first().seq == 2  # complete already
    saved.save(one)
    assert saved.versions() == [1, 2] and saved.load(1).first().seq == 2 and saved.load(0) is None
    add = saved.sink(["k"], "seq")
    add(spark.createDataFrame([("a", 5), ("b", 1)], "k string, seq long"), 3)
    add(spark.createDataFrame([("a", 9)], "k string, seq long"), 3)  # the same batch again
    assert sorted(map(tuple, saved.load().collect())) == [("a", 5), ("b", 1)]


def test_correction_in_batches(spark):
    pages = spark.createDataFrame([("d", k) for k in range(1, 6)], "source_pdf string, page int").select("source_pdf", "page", F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(False).alias("is_blank"), F.lit("").alias("text"), F.lit("").alias("source_text"), F.lit(None).cast(schemas.PAGE_CORRECTION).alias("correction"))
    none = F.lit(None).cast("string")
    blocks = spark.createDataFrame([("d", k, 0, f"txt{k}") for k in (1, 2, 4, 5)], "source_pdf string, page int, pos int, text string").select("source_pdf", "page", "pos", none.alias("block_id"), "text", none.alias("source_text"), none.alias("block_type"), F.lit(0).alias("reading_order"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast(schemas.BLOCK_CORRECTION).alias("correction"))
    asked = correct.requests(correct.run(pages, blocks, None)[0], 3).orderBy("batch").collect()
    assert [(r.pages, r.current_page, r.completed_pages, r.total_pages) for r in asked] == [(3, 4, 3, 4), (1, 5, 4, 4)]

    def provider(b):
        item = F.struct("block_id", F.concat("text", F.lit("!")).alias("text"), F.lit("").alias("status"), F.lit(None).cast("array<string>").alias("reasons"), F.lit(False).alias("protected"), F.lit(None).cast("array<string>").alias("notes"))
        page = F.struct("page", F.lit("").alias("status"), F.lit(None).cast("array<string>").alias("notes"), F.array(item).alias("blocks"))
        return b.groupBy("source_pdf", "batch").agg(F.collect_list(page).alias("pages")).withColumn("seconds", F.lit(1.5))

    _, out, counters = correct.run_in_batches(pages, blocks, provider, 3)
    assert sorted(b.text for b in out.collect()) == ["txt1!", "txt2!", "txt4!", "txt5!"]
    assert tuple(counters.first()) == (2, 3.0, 4)


# ---- progress


def test_job_machine(spark, tmp_path):
    changes = [("a", 1, "pending"), ("a", 2, "running"), ("a", 3, "succeeded"), ("a", 4, "running"), ("a", 5, "pending"), ("b", 1, "running"), ("b", 2, "skipped"), ("c", 1, "pending"), ("c", 2, "running"), ("c", 3, "failed"), ("c", 4, "running")]
    schema = "input_pdf string, seq long, status string, retryable boolean"
    for k in range(2):  # two batches: state is carried over
        spark.createDataFrame([(*c, c[0] != "c") for c in changes if (c[1] > 2) == bool(k)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.input_pdf, r.seq): (r.from_status, r.legal, r.attempts) for r in machine.run_changes(spark, stream).collect()}
    assert got == {("a", 1): ("", True, 0), ("a", 2): ("pending", True, 0), ("a", 3): ("running", True, 1), ("a", 4): ("succeeded", False, 1), ("a", 5): ("succeeded", True, 0), ("b", 1): ("", False, 0), ("b", 2): ("", True, 0), ("c", 1): ("", True, 0), ("c", 2): ("pending", True, 0), ("c", 3): ("running", True, 1), ("c", 4): ("failed", False, 1)}


def test_a_silent_job_is_stalled(spark, tmp_path):
    schema = "input_pdf string, seq long, status string, retryable boolean"
    rows = [("a", 1, "pending", True), ("a", 2, "running", True), ("b", 1, "pending", True), ("b", 2, "running", True), ("b", 3, "failed", True)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = []
    with machine.state_store(spark):
        told = machine.job_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), stalled_ms=1)
        query = told.writeStream.foreachBatch(lambda df, n: found.extend(tuple(r)[:4] for r in df.where("legal is null").collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        began = time.monotonic()
        while len(query.recentProgress) < 4 and time.monotonic() - began < 60 and query.isActive:
            time.sleep(0.5)
        query.stop()
    assert found == [("a", 2, "running", "stalled")]


def test_the_page_at_hand_prints_nothing(spark):
    rows = [("r", k, 0.1 * k, "page_done", "s", k, 2, 9) for k in range(4)]
    e = spark.createDataFrame(rows, "run string, seq long, at double, phase string, stage string, current_page long, completed_pages long, total_pages long")
    assert progress.rendered(e, live=True).count() == 1


def test_batch_progress(spark):
    moves = [("a", "pending", "start"), ("b", "pending", "start"), ("a", "running", "job_started"), ("b", "running", "job_started"), ("a", "succeeded", "job_done"), ("b", "failed", "job_done"), ("b", "running", "page"), ("b", "running", "page")]
    t = spark.createDataFrame([("x", k, 0.1 * k, p, s, f, "ocr", 0, 0) for k, (p, s, f) in enumerate(moves)], "batch string, seq long, at double, input_pdf string, status string, phase string, stage string, completed_pages long, total_pages long")
    snaps = progress.batch_snapshots(t)
    got = [(r.total, r.pending, r.running, r.succeeded, r.failed, r.completed) for r in snaps.orderBy("seq").collect()]
    assert got == [(1, 1, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (2, 1, 1, 0, 0, 0), (2, 0, 2, 0, 0, 0), (2, 0, 1, 1, 0, 1), (2, 0, 0, 1, 1, 2), (2, 0, 1, 1, 0, 1), (2, 0, 1, 1, 0, 1)]
    assert [r.seq for r in progress.rendered_batch(snaps).orderBy("seq").collect()] == [0, 1, 2, 3, 4, 5]
    assert [r.seq for r in progress.rendered_batch(snaps, live=True).orderBy("seq").collect()] == [0, 1, 2, 3, 4, 5, 6]


def test_shard_summary(spark):
    runs = spark.createDataFrame([(1, "s1-w2", 1, 2, "manual", 20.0, 30.0, 9.0, 20.0), (2, "s4-auto", 4, None, "auto", 5.0, 120.0, 9.5, 4.0)], "run_no long, label string, shards int, workers int, mode string, elapsed_seconds double, pages_per_minute double, ocr_seconds_total double, slowest_shard_seconds double")
    text = bench.shard_markdown(bench.relative(runs), "now", "in.pdf", "p", False, 2, "manual").first().value
    assert text.startswith("# Process Shard Benchmark\n\n- Generated at: `now`\n") and "- Local only: `false`\n- Max workers per shard: `2` (manual)\n\n| Label" in text
    assert "| `s4-auto` | 4 | 0 | auto | 5.000 | 120.000 | 9.500 | 4.000 | 4.00x | 4.00x |" in text and text.endswith("\n- Fastest run: `s4-auto`\n")


def test_profile_map_has_21_entries(spark):
    row = ("w1", "w2", 1.0, 0.5, 2.0, 0.5, 4.0)
    t = spark.createDataFrame([(*row, k) for k in (0.0, 0.5, 10.0)], "render_worker string, recognize_worker string, render_seconds double, queue_wait_seconds double, recognize_seconds double, postprocess_seconds double, total_seconds double, at double").withColumn("started_at", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    got = {r.key.removeprefix("x_"): r.value for r in telemetry.profile_map(t, F.lit(6.0), 3, "x").collect()}
    assert len(got) == 21 and got["seconds"] == 6.0 and got["page_seconds_total"] == 12.0 and got["page_effective_parallelism"] == 2.0
    assert (got["max_active_pages"], got["max_active_render_workers"], got["max_active_recognize_workers"], got["max_queued_rendered_pages"], got["render_queue_capacity"], got["render_workers"]) == (2, 2, 2, 1, 3, 1)


def test_json_with_sorted_keys(spark):
    rows = spark.range(1).select(F.lit(1).alias("b"), F.struct(F.lit("z").alias("z"), F.array(F.struct(F.lit(2).alias("y"), F.lit(None).cast("int").alias("c"))).alias("a")).alias("a"), F.create_map(F.lit("q"), F.lit(1), F.lit("p"), F.lit(2)).alias("m"))
    assert D.as_json(rows, sort_keys=True).first().value == '{"a":{"a":[{"c":null,"y":2}],"z":"z"},"b":1,"m":{"p":2,"q":1}}'
