"""Packing in the order of any files, one text in very many copies, long pieces, and columns with the operators' own names."""

import collections
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folio.llm import _tokens as K
from folio.llm import exact_dedup, lm_scoring, mixing, ngram_join, packing, suffix, suffix_dedup, token_counts, token_output
from folio.session import keep
from folio.llm.queries import tokenizer

WORD = "word_bpe_49k.json"


def spread(spark, n=600):
    return spark.createDataFrame([(i, " ".join("the of and".split()[(i + k) % 3] for k in range(1 + i % 90))) for i in range(n)], "doc_id long, text string")


def check(pieces, n, in_order=True):
    """Every id once, no two pieces at one place, and batches in the order of the rows."""
    places = collections.Counter((p.sequence_id, p.offset) for p in pieces)
    assert max(places.values()) == 1
    inside = collections.defaultdict(list)
    for p in pieces:
        inside[p.sequence_id].append((p.offset, p.length))
    for at in inside.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0) and {p.doc_id for p in pieces} == set(range(n))
    if in_order:
        spans = collections.defaultdict(list)
        for p in pieces:
            spans[p.sequence_id >> packing.WINDOW_BITS].append(p.doc_id)
        ends = [(min(spans[k]), max(spans[k])) for k in sorted(spans)]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_packing_of_files_that_one_task_cut(spark, tmp_path):
    """A task with more rows than a file may hold writes -c000, -c001 and so on."""
    spread(spark).coalesce(1).sortWithinPartitions("doc_id").write.option("maxRecordsPerFile", 50).parquet(str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("part-*"))) == 12
    check(packing.pack_in_order(spark.read.parquet(str(tmp_path / "t")), tokenizer(WORD), 2, window=256).collect(), 600)


def test_packing_of_one_file_of_any_name(spark, tmp_path):
    spread(spark).coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("part-*")).rename(tmp_path / "documents.parquet")
    check(packing.pack_in_order(spark.read.parquet(str(tmp_path / "documents.parquet")), tokenizer(WORD), 2, window=256).collect(), 600)


def test_packing_of_a_table_without_files(spark):
    table = spread(spark).repartition(3)
    check(packing.pack_in_order(table, tokenizer(WORD), 2, window=256).collect(), 600, in_order=False)
    joined = table.join(table.select(F.col("doc_id").alias("other")), F.col("doc_id") == F.col("other")).drop("other")
    check(packing.pack_in_order(joined, tokenizer(WORD), 2, window=256).collect(), 600, in_order=False)


def test_packing_of_more_tasks_than_five_digits(spark, tmp_path):
    """Numbers, not names, order the files; and ids fit far beyond the old bounds."""
    for number, (a, b) in {"99999": (0, 200), "100000": (200, 400), "100001": (400, 600)}.items():
        spread(spark).where(f"doc_id >= {a} and doc_id < {b}").coalesce(1).sortWithinPartitions("doc_id").write.parquet(str(tmp_path / number))
        (tmp_path / "all").mkdir(exist_ok=True)
        next((tmp_path / number).glob("part-*")).rename(tmp_path / "all" / f"part-{number}-x-c000.parquet")
    check(packing.pack_in_order(spark.read.parquet(str(tmp_path / "all")), tokenizer(WORD), 2, window=256).collect(), 600)
    assert packing.stretch_id(10**12) < 2**63
    with pytest.raises(ValueError, match="no sequence ids"):
        packing.stretch_id(1 << packing.ROW_BITS)


def test_one_text_in_many_copies_leaves_two_marks_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "STRETCH_BITS", 6)
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text")).repartition(2)
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.duplicate_groups(docs).collect()}
    assert got == {(k, 0, 4500) if k % 10 < 9 else (k, k, 1) for k in range(5000)}
    assert exact_dedup.drop_duplicates(docs).count() == 501
    # Copies that lie far apart, one in each stretch, are found as well.
    apart = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 500 == 0, "far").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text")).repartition(1)
    assert exact_dedup.drop_duplicates(apart).count() == 1997


def test_caches_are_bounded_in_ids(monkeypatch):
    monkeypatch.setattr(K, "CACHE_IDS", 4000)
    cache, r = K.PieceCache(tokenizer("byte_bpe_50k.json")), random.Random(1)
    most = 0
    for _ in range(20):
        text = "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(600)).encode()
        ids, off = cache.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 2)
        assert ids[:-1].tolist() == cache.lib.model.encode(text.decode(), add_special_tokens=False).ids
        most = max(most, cache.flat.nbytes)
    assert most <= 2 * 2 * (4000 + 2 * 3000) + (1 << 18)


def test_long_pieces_are_not_sent_to_the_driver(spark):
    r = random.Random(2)
    texts = ["".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(300)) for _ in range(20)] + ["the cat sat on the mat " * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = tokenizer("piece_bpe_32k.model")
    pieces = token_counts.frequent_pieces(docs, path)
    assert pieces and all(len(p["piece"]) <= token_counts.PIECE_BYTES for p in pieces)
    model = K.Library(path).model
    assert {x.doc_id: x.n_tokens for x in token_counts.count_tokens(docs, path).collect()} == {i: len(model.encode(t)) for i, t in enumerate(texts)}


NAMES = ["print", "__print", "maybe", "__maybe", "slot0", "__slot0", "__bucket0", "__bitmap1", "bucket", "doc", "id", "group", "keep_id", "__group", "__keep", "gone", "__gone_id", "row", "mix_position", "mix_x", "mix__hash", "mix_stream", "stretch", "a.b"]


def test_rows_keep_columns_of_any_name(spark):
    rows = [(k, " ".join(f"w{(k // 2 * 7 + j) % 40}" for j in range(20)), "en", f"s{k % 2}", *[f"{c}{k}" for c in NAMES]) for k in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *NAMES])
    by = {r[0]: r for r in rows}
    for out in (exact_dedup.drop_duplicates(docs), exact_dedup.without_ids(docs, spark.createDataFrame([(3,)], "doc_id long")), mixing.ordered(docs), ngram_join.drop_near_duplicates(docs)):
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(tuple(r) == by[r.doc_id] for r in got)


def test_tiny_weights_have_positions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "big").otherwise("tiny").alias("source"))
    mixed = mixing.mix(docs, {"big": 1.0, "tiny": 1e-15}).select("doc_id", "source", "mix_position").collect()
    assert len({r.mix_position for r in mixed}) == 3000 and min(r.mix_position for r in mixed) >= 0
    first = sorted(mixed, key=lambda r: r.mix_position)
    assert sum(r.source == "tiny" for r in first[:1000]) <= mixing.BLOCK_ROWS


def test_empty_token_files_and_pipeline(spark, tmp_path):
    import corpus_pipeline

    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    token_output.write_token_files(empty, str(tmp_path / "tokens"), tokenizer("byte_bpe_50k.json"), 2)
    assert token_output.read_token_files(spark, str(tmp_path / "tokens"), digest=True).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pairs_of_contexts_are_decided_by_their_bytes(spark):
    same, other = "a passage of its own, " * 12, "quite another passage " * 12
    docs = spark.createDataFrame([(1, same), (2, same), (3, other)], "doc_id long, text string")
    entries = "doc long, start long, windows long, anchor long, size long, first_doc long, first_start long"
    pairs = spark.createDataFrame([(2, 0, 5, None, None, 1, 0), (3, 0, 5, None, None, 1, 0)], entries)
    assert {(r.doc, r.start, r.windows) for r in suffix_dedup.compare(docs, pairs).collect()} == {(2, 0, 5)}


def test_groups_of_contexts_give_a_pair_and_the_rest():
    e = np.zeros(6, suffix_dedup._ENTRY)
    e["anchor"], e["context"], e["doc"], e["start"], e["windows"] = 7, [1, 1, 1, 2, 3, 3], [4, 2, 9, 1, 5, 5], [0, 0, 0, 3, 8, 2], 6
    pairs, later = suffix_dedup._pairs(*suffix_dedup._earliest(e))
    assert pairs[["doc", "start", "first_doc", "first_start"]].tolist() == [(4, 0, 2, 0), (5, 8, 5, 2)]
    assert later.tolist() == [(9, 0, 6)]


def test_copies_are_not_sorted_again_word_by_word(monkeypatch):
    r = np.random.default_rng(4)
    parts = [r.integers(97, 123, 150, dtype=np.uint8) for _ in range(60)]
    t = np.concatenate([parts[k] for k in r.permutation(np.repeat(np.arange(60), 3))])
    w, sorted_, lexsort = suffix.words_at(t), [0], np.lexsort

    def counted(keys):
        sorted_[0] += len(keys[0])
        return lexsort(keys)

    monkeypatch.setattr(np, "lexsort", counted)
    sa = suffix.suffix_array(t, w)
    monkeypatch.undo()
    assert sorted_[0] < len(t) // 2  # before, every copied suffix was sorted for each of its words: 4 times the text
    raw = t.tobytes()
    cut = [raw[i : i + suffix.DEPTH].ljust(suffix.DEPTH, b"\0") for i in sa.tolist()]
    assert cut == sorted(cut) and sorted(sa.tolist()) == list(range(len(t)))
    for length in (8, 50, 100):
        assert (suffix.shared(sa, w, length) == (suffix.common_prefixes(sa, w) >= length)).all()


def test_a_shard_answers_many_chunks_at_once(monkeypatch):
    # Shards and chunks both grew with the text, and every pair of them had look-ups of its own.
    assert [lm_scoring.shard_bits(n << 30) for n in (0, 1, 9, 40)] == [11] * 4 and lm_scoring.shard_bits(1 << 40) == 16
    r, bits, shard = np.random.default_rng(6), 11, 5
    own = lambda n: np.sort(r.integers(0, 1 << 53, n, dtype=np.uint64)) | np.uint64(shard << 53)
    known = np.unique(own(500))
    part = lm_scoring.Model(shard, shard + 1, bits, known, r.integers(1, 1 << 40, len(known)), np.zeros(1, np.uint64), np.array([200], np.uint64), r.integers(0, 1 << 63, 200, dtype=np.uint64))
    kinds = r.integers(1, 4, 300)
    asked = [(r.choice(known, 40) if j % 2 else own(j % 50)) for j in range(300)]
    raw = [h.tobytes() if k == 1 else lm_scoring._pack_keys(h, bits) for h, k in zip(asked, kinds, strict=True)]
    calls, look_up, none = [], lm_scoring.look_up, np.zeros(0, np.uint64)
    monkeypatch.setattr(lm_scoring, "look_up", lambda *x: calls.append(1) or look_up(*x))
    for most in (1 << 20, 1000):
        calls.clear()
        monkeypatch.setattr(lm_scoring, "_ANSWERS", most)
        got = lm_scoring.answers_to(kinds, raw, part, 3)
        assert len(calls) <= 3 + 300 * 50 // most
        for k, h, data in zip(kinds, asked, got, strict=True):
            c, level = look_up([part], h if k == 1 else none, [none if k == 1 else h])
            assert data == (c if k == 1 else level[0]).tobytes()
    assert lm_scoring.answers_to(np.zeros(0, np.int32), [], part, 3) == []


def test_rows_of_megabytes_are_kept_in_small_row_groups(spark):
    df = spark.range(0, 30, 1, 1).selectExpr("id", "cast(rpad(cast(id as string), 3000000, uuid()) as binary) as data")
    for wide, most in ((True, 2), (False, 30)):
        back = keep(df, "wide", wide=wide)
        groups = pq.ParquetFile(next(f for f in back.inputFiles()).removeprefix("file://")).metadata
        assert groups.num_rows == 30 and max(groups.row_group(k).num_rows for k in range(groups.num_row_groups)) <= most
        assert back.where("octet_length(data) = 3000000").count() == 30


def test_no_model_passes_through_the_driver(spark, monkeypatch):
    # A model of up to 384 MB was read by the driver and broadcast, which took more than the driver has.
    def refused(*_):
        raise AssertionError("the model is at the driver")

    table = [(i, " ".join(f"w{(i * k) % 41}" for k in range(i % 60))) for i in range(200)] + [(None, "w1 w2 " * 70_000), (500, None), (501, "w3 " * 90_000)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    want = lm_scoring.score(docs, max_broadcast=1 << 30, entry_bits=400).collect()
    for module, name in ((lm_scoring, "share"), (type(spark.sparkContext), "broadcast")):
        monkeypatch.setattr(module, name, refused)
    monkeypatch.setattr(lm_scoring, "_ASK_CHUNK", 3000)
    by = lambda x: (x.doc_id is None, x.doc_id)
    got = sorted(lm_scoring.score(docs, entry_bits=400).collect(), key=by)
    assert len(got) == 203
    for g, w in zip(got, sorted(want, key=by), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_packed_keys_come_back_in_lists():
    r = np.random.default_rng(8)
    for bits in (11, 24, 30):
        low, shard = max(0, 64 - bits - 40), 3
        lists = [np.sort(r.integers(0, 1 << (64 - bits), n, dtype=np.uint64)) >> np.uint64(low) << np.uint64(low) | np.uint64(shard << (64 - bits)) for n in (0, 700, 1, 0, 60, 0)]
        raw = [lm_scoring._pack_keys(x, bits) for x in lists]
        assert [len(x) for x in raw] == [5 * len(x) for x in lists]
        assert (lm_scoring._unpack_keys(raw, shard, bits) == np.concatenate(lists)).all()
        cut = np.append(0, np.cumsum([len(x) for x in lists])).tolist()
        assert lm_scoring._pack_keys(np.concatenate(lists), bits, cut) == b"".join(raw)
        assert len(lm_scoring._unpack_keys([], shard, bits)) == 0


def test_shuffle_files_of_a_kept_table_are_released(spark):
    left = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    spark.range(9).groupBy("id").count().write.format("noop").mode("overwrite").save()
    before = left()
    kept = keep(spark.range(0, 1000, 1, 3).groupBy((F.col("id") % 7).alias("k")).count(), "released", release=True)
    assert left() <= before and kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
