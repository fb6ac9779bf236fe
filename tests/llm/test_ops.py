"""The corpus operators against brute force on small fixtures with awkward rows."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import exact_dedup, lm_scoring, mixing, ngram_join, packing, pfor, quality_classifier, quality_rules, suffix, suffix_dedup, token_counts, token_output
from folio.llm import _bytes as B
from folio.llm import _tokens as K
from folio.llm._components import connected_components
from folio.llm.queries import tokenizer

SPACE = r"[\x20\x09-\x0D]"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = [a + b for a in ("the", "of", "an", "ti", "é", "ß", "zu") for b in ("on", "er", "", "le", "ñ")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def corpus():
    r = random.Random(3)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    shared = say(60)
    texts = [say(r.randint(1, 400)) for _ in range(50)]
    texts += [None, "", "   ", "\n\t", "one", "two words", " lead  and nbsp \r\n x", "<|endoftext|> a<s>b 한국어", "a" * 5000, "Ab, cd. " * 900]
    base = say(200).split()
    for k in range(12):  # near copies
        w = list(base)
        for i in range(k):
            w[(37 * i + k) % 200] = f"edit{k}x{i}"
        texts.append(" ".join(w))
    texts += [say(30) + " " + shared + " " + say(30) for _ in range(6)]
    texts += [texts[0]] * 4 + [texts[1].replace(" ", "\n")]
    texts.append(say(20000))
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)]


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    """Several partitions; extra columns whose names the operators might use themselves."""
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 7 else None, "x", 1) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, print string, n int").repartition(4).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    host = F.col("source")
    results = [
        lm_scoring.score(empty),
        suffix_dedup.remove_repeats(empty),
        mixing.mix(empty),
        quality_classifier.classify(empty, labels, host, host),
        exact_dedup.duplicate_groups(empty),
        exact_dedup.drop_duplicates(empty),
        ngram_join.near_duplicates(empty),
        ngram_join.drop_near_duplicates(empty),
        token_counts.count_tokens(empty, tokenizer("piece_bpe_32k.model")),
        quality_rules.judge(empty),
        quality_rules.keep_good(empty),
        packing.pack_documents(empty, tokenizer("word_bpe_49k.json"), 2),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_missing_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    odd = spark.createDataFrame([(None, text, None, None), (None, None, "en", "a"), (5, text, "en", "a"), (5, text, "en", "a"), (7, None, None, None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    host = F.col("source")
    assert lm_scoring.score(odd).count() == 5
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(odd).collect()) == [0] * 5
    assert mixing.mix(odd).select("mix_position").distinct().count() == 5
    assert quality_classifier.classify(odd, labels, host, host).where("kept").count() == 5
    assert exact_dedup.duplicate_groups(odd).count() == 5
    assert exact_dedup.drop_duplicates(odd).count() == 2
    near = ngram_join.near_duplicates(odd).collect()
    assert len(near) == 5 and {r.component_id for r in near} == {None, 5, 7}
    assert token_counts.count_tokens(odd, tokenizer("piece_bpe_32k.model")).count() == 5
    assert quality_rules.judge(odd).count() == 5
    packed = packing.pack_documents(odd, tokenizer("word_bpe_49k.json"), 2).collect()
    assert sum(p.start == 0 for p in packed) == 5 and sum(p.length for p in packed) == sum(p.doc_tokens for p in packed if p.start == 0)


def test_word_hashes_and_ngrams():
    texts = [t or "" for _, t in DOCS]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h, at = B.word_hashes(buf, off)
    want = [w.translate(LOWER) for t in texts for w in words(t)]
    assert len(h) == len(want) and len(set(zip(h.tolist(), want, strict=True))) == len(set(want)) == len(set(h.tolist()))
    grams, first = B.ngrams(h, at, 3)
    assert len(grams) == sum(max(0, len(words(t)) - 2) for t in texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_pieces_give_the_librarys_ids(name):
    import pyarrow as pa

    texts = [t or "" for _, t in DOCS] + [" a  b  c \n\n d\t\te's we'll", "\x1c a \x85 b", "　 x", "▁ y ▁", "a.b, c:d (e)", "é x", "\r\n\r\n x"]
    cache = K.PieceCache(tokenizer(name))
    got = []
    for part, buf, off in B.chunks(pa.record_batch({"text": pa.array(texts)}), "text", 1000):
        ids, at = cache.encode(buf, off, None)
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(len(at) - 1)]
    lib = cache.lib.model
    want = lib.encode(texts, num_threads=1) if name.endswith(".model") else [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert got == want


@pytest.mark.parametrize("percentile", [0.0, 0.5, 0.9, 1.0])
def test_pfor_round_trip(percentile):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint16), np.array([7]), np.full(128, 50256), rng.integers(0, 50257, 1000), rng.zipf(1.3, 5000) % 50257, np.array([0, 2**31] * 70)):
        s = pfor.Segment(pfor.encode(ids, percentile))
        assert np.array_equal(s.decode(), ids)
        for a, b in ((0, 1), (100, 300), (127, 129), (900, 10**6)):
            assert np.array_equal(s.decode(a, b), ids[a:b])


def test_token_files(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_output.write_token_files(docs, path, tokenizer("byte_bpe_50k.json"), 2)
    lib = K.Library(tokenizer("byte_bpe_50k.json")).model
    got, crc, at = rows(token_output.read_token_files(spark, path)), rows(token_output.read_token_files(spark, path, digest=True)), 0
    for i, t in sorted(DOCS):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].token_ids) == (at, len(ids), ids)
        assert crc[i].ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)


def test_token_counts(docs):
    lib = K.Library(tokenizer("piece_bpe_32k.model")).model
    for table in (0, 50, 1 << 16):
        got = rows(token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model"), limit=100, table=table))
        for i, t in DOCS:
            n = len(lib.encode(t or ""))
            assert tuple(got[i]) == (i, len((t or "").encode()), n, n > 100)


def test_packing(docs):
    lib = K.Library(tokenizer("word_bpe_49k.json")).model
    pieces = packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), 2, window=512, with_ids=True).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, t in DOCS:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        mine = sorted(by_doc[i], key=lambda p: p.start)
        assert [p.start for p in mine] == np.cumsum([0, *[p.length for p in mine[:-1]]]).tolist()
        assert b"".join(bytes(p.ids) for p in mine) == struct.pack(f"<{len(ids)}I", *ids)
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(bytes(p.ids)) for p in mine)
    for content in by_seq.values():
        content.sort(key=lambda p: p.offset)
        used = sum(p.length for p in content)
        assert [p.offset for p in content] == np.cumsum([0, *[p.length for p in content[:-1]]]).tolist()
        assert used <= 512 and used & (used - 1) == 0


def brute_best_fit(lengths, window):
    """Every window looked at for every piece."""
    rest, done = [], []
    for d, n in enumerate(lengths):
        done += [[(d, k, window)] for k in range(0, n - n % window, window)]
        if n % window:
            rest.append((d, n - n % window, n % window))
    still, over = divmod(sum(n for _, _, n in rest), window)
    open_, turn = [[1 << b, [], 0] for b in range(13) if over >> b & 1], 0
    while rest:
        rest.sort(key=lambda x: (-x[2], x[0], x[1]))
        d, start, n = rest.pop(0)
        fits = [w for w in open_ if w[0] >= n]
        if fits:
            w = min(fits, key=lambda w: (w[0], -w[2]))  # of equal windows the one used last
        elif still:
            still -= 1
            open_.append(w := [window, [], 0])
        else:
            w = max(open_, key=lambda w: (w[0], w[2]))
            rest.append((d, start + w[0], n - w[0]))
            n = w[0]
        w[1].append((d, start, n))
        turn += 1
        w[0], w[2] = w[0] - n, turn
    assert all(w[0] == 0 for w in open_)
    return done + [w[1] for w in open_]


@pytest.mark.parametrize(("low", "high"), [(2100, 4000), (1500, 3000), (1, 900), (1, 20000), (4096, 4097)])
def test_packing_is_best_fit_decreasing(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 400)
    got, want = packing.pack_lengths(lengths, 4096), brute_best_fit(lengths.tolist(), 4096)
    assert sorted(map(sorted, got)) == sorted(map(sorted, want))
    assert all((n := sum(p[2] for p in w)) == 4096 or n & (n - 1) == 0 for w in got)  # no padding at all
    pieces = sorted(p for w in got for p in w)
    assert sum(p[2] for p in pieces) == lengths.sum() and all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:]))
    if high == 4000:
        cut = len({p[0] for p in pieces if p[2] < lengths[p[0]]})
        assert cut <= 0.45 * len(lengths)


def test_best_fit_takes_the_tightest_window():
    tree = packing.CapacityTree(16)
    for window, room in enumerate((5, 9, 3, 9)):
        tree.put(room, window)
    assert tree.take(4) == (5, 0) and tree.take(4) == (9, 3) and tree.take(3) == (3, 2) and tree.take(10) is None and tree.take(9) == (9, 1) and tree.take(1) is None


def test_packing_keeps_the_order_of_files(spark, tmp_path):
    table = spark.createDataFrame([(i, " ".join(WORDS[(i + k) % len(WORDS)] for k in range(1 + i % 90))) for i in range(900)], "doc_id long, text string")
    table.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "t"))
    pieces = packing.pack_in_order(spark.read.parquet(str(tmp_path / "t")), tokenizer("word_bpe_49k.json"), 2, window=256).collect()
    spans = collections.defaultdict(list)
    for p in pieces:
        spans[p.sequence_id >> packing.WINDOW_BITS].append(p.doc_id)
    ends = [(min(spans[k]), max(spans[k])) for k in sorted(spans)]
    assert len(ends) >= 5 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0) and {p.doc_id for p in pieces} == set(range(900))


def test_exact_dedup(docs):
    groups = collections.defaultdict(list)
    norm = {i: re.sub(SPACE + "+", " ", t or "") for i, t in DOCS}
    for i, t in norm.items():
        groups[t].append(i)
    got = rows(exact_dedup.duplicate_groups(docs))
    for i, t in norm.items():
        g = groups[t]
        assert tuple(got[i]) == (i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest())
    left = exact_dedup.drop_duplicates(docs)
    assert sorted(r.doc_id for r in left.collect()) == sorted(min(g) for g in groups.values()) and left.columns == docs.columns


def test_exact_dedup_with_a_full_filter(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 64)
    monkeypatch.setattr(exact_dedup, "_BLOCK", 32768)
    assert exact_dedup.drop_duplicates(docs).count() == len({re.sub(SPACE + "+", " ", t or "") for _, t in DOCS})


def test_exact_dedup_keeps_one_row_of_every_group(spark):
    table = [(None, "a  b"), (None, "a b"), (None, "a\tb"), (4, "c"), (4, "c"), (9, "c"), (None, "c"), (5, "d"), (None, "e")]
    table += [(100 + k, "hot copy") for k in range(2500)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    got = collections.defaultdict(list)
    for r in exact_dedup.duplicate_groups(docs).collect():
        got[r.text_sha256].append(r)
    want = {"a b": (None, 3), "c": (4, 4), "d": (5, 1), "e": (None, 1), "hot copy": (100, 2500)}
    for text, (keep_id, size) in want.items():
        mine = got.pop(hashlib.sha256(text.encode()).hexdigest())
        assert len(mine) == size and {(r.keep_id, r.group_size) for r in mine} == {(keep_id, size)}
        assert [r.doc_id for r in mine if r.kept] == [keep_id]
    assert not got
    assert sorted(str(r.doc_id) for r in exact_dedup.drop_duplicates(docs).collect()) == sorted(map(str, (None, None, 4, 5, 100)))


def test_only_possible_repeats_leave_their_task(spark):
    """Of unique rows only two-byte places move: no exchange but that of the filter carries rows."""
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(3000)], "doc_id long, text string").repartition(3)
    prints = exact_dedup._prints(docs, "text", "doc_id")
    maps, bits = exact_dedup.repeated_filter(prints)
    assert exact_dedup.with_maybe(prints, maps, bits).where("maybe").count() <= 60


def brute_components(documents):
    sets = {}
    for i, t in documents:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("part", "block", "small"), [(8192, 2048, 8), (3, 3, 1)])
def test_near_duplicates(docs, monkeypatch, part, block, small):
    for name, v in (("PART", part), ("BLOCK_PART", block), ("SMALL_RUN", small)):
        monkeypatch.setattr(ngram_join, name, v)
    got = {i: (r.n_shingles, r.component_id) for i, r in rows(ngram_join.near_duplicates(docs)).items()}
    assert got == brute_components(DOCS)


@pytest.mark.parametrize(("part", "block", "small"), [(8192, 4096, 8), (3, 3, 1)])
def test_near_duplicates_count_all_links(spark, monkeypatch, part, block, small):
    for name, v in (("PART", part), ("BLOCK_PART", block), ("SMALL_RUN", small)):
        monkeypatch.setattr(ngram_join, name, v)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[:k]) for k in range(40, 61, 2)]
    texts += texts[:2] + ["", "alone in the world with these words"]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    want = {i: sum(1 for j, y in enumerate(sets) if i != j and x and y and 4 * len(x & y) >= 3 * len(x | y)) for i, x in enumerate(sets)}
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.n_links for r in got.collect()} == want


def test_drop_near_duplicates(docs):
    left = ngram_join.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in brute_components(DOCS).values()}) and left.columns == docs.columns


def test_count_tree_finds_all_that_may_link():
    rng = np.random.default_rng(5)
    vec = rng.poisson(3, (300, ngram_join.GROUPS)).astype(np.int32)
    vec[100:200] = vec[:100] + rng.poisson(0.1, (100, ngram_join.GROUPS))
    n = vec.sum(axis=1).astype(np.int64)
    tree = ngram_join.CountTree(n, vec)
    for q in range(0, 300, 7):
        want = {k for k in range(300) if ngram_join.may_link(np.array([np.minimum(vec[k], vec[q]).sum()]), np.array([n[k]]), n[q])[0]}
        assert set(tree.order[tree.search(int(n[q]), vec[q])].tolist()) == want


def test_components(spark):
    edges = [(i + 1, i) for i in range(1, 20)] + [(100, 101), (101, 102), (50, 50), (102, 100)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 21)} | {100: 100, 101: 100, 102: 100}


def test_suffix_array():
    rng = np.random.default_rng(2)
    for t in (rng.integers(0, 3, 500), rng.integers(0, 256, 300), np.zeros(90), np.frombuffer(b"banana" * 14, np.uint8), np.array([5]), np.zeros(0)):
        t = t.astype(np.uint8)
        w = suffix.words_at(t)
        sa = suffix.suffix_array(t, w)
        raw = t.tobytes()
        assert sorted(sa.tolist()) == list(range(len(raw)))
        cut = [raw[i : i + suffix.DEPTH].ljust(suffix.DEPTH, b"\0") for i in sa.tolist()]
        assert cut == sorted(cut)
        lcp = suffix.common_prefixes(sa, w)
        for k in range(1, len(sa)):
            a, b = cut[k - 1], cut[k]
            assert lcp[k] == next((j for j in range(suffix.DEPTH) if a[j] != b[j]), suffix.DEPTH)


def brute_removed(documents):
    seen, out = set(), {}
    for i, t in sorted(documents):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("part", "heavy"), [(4096, 1 << 18), (1, 1)])
def test_suffix_dedup(docs, monkeypatch, part, heavy):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    monkeypatch.setattr(suffix_dedup, "HEAVY_LEAST", heavy)
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in rows(suffix_dedup.remove_repeats(docs, digest=True)).items()}
    assert got == brute_removed(DOCS)
    kept = rows(suffix_dedup.remove_repeats(docs))
    for i, r in kept.items():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == got[i][3] and sum(s.end - s.start for s in r.spans) == got[i][1]


def brute_rules(text):
    w = words(text)
    triples = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {j for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_rules(spark, docs):
    got = rows(quality_rules.judge(docs))
    for i, t in DOCS:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(t or "")
        assert not (r.base_failed and r.kept)
    clean = [(k, " ".join(random.Random(k).choices(WORDS, k=150))) for k in range(40)]
    junk = [(100, " ".join(f"{w}###" for w in clean[0][1].split())), (101, clean[1][1].upper() + "!!" * 40)]
    long = (102, " ".join(f"w{k % 9000}" for k in range(18000)))
    table = spark.createDataFrame([(i, t, "en") for i, t in [*clean, *junk, long]], "doc_id long, text string, lang string")
    verdict = rows(quality_rules.judge(table))
    assert all(verdict[i].kept for i, _ in clean) and not verdict[100].kept
    assert verdict[102].n_repeat_words == 18000
    left = {r.doc_id for r in quality_rules.keep_good(table).collect()}
    assert left == {i for i, r in verdict.items() if r.kept}


def brute_word_verdicts(table):
    """Word distances of documents that pass the base rules, language by language."""
    out, by = {}, collections.defaultdict(list)
    for i, t, lang in table:
        by[lang].append((i, words(t or ""), not brute_rules(t or "")[5]))
    for group in by.values():
        counts = collections.Counter(w for _, ws, _ in group for w in ws)
        common = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.COMMON_WORDS]]
        hist = {i: np.array([*(ws.count(c) for c in common), sum(w not in common for w in ws)], float) for i, ws, _ in group}
        pool = sum(hist[i] for i, _, good in group if good)
        for i, ws, good in group:
            p, q = hist[i] / hist[i].sum(), pool / pool.sum()
            kl = lambda x: sum(v * np.log2(2 * v / (a + b)) for v, a, b in zip(x, p, q, strict=True) if v)  # noqa: E731, B023
            out[i] = np.sqrt((kl(p) + kl(q)) / 2)
    return out


@pytest.mark.parametrize("langs", [3, 1000])
def test_word_rule_with_many_languages(spark, monkeypatch, langs):
    monkeypatch.setattr(quality_rules, "BROADCAST_LANGS", langs)
    monkeypatch.setattr(quality_rules, "LITERAL_LANGS", langs)
    r = random.Random(8)
    speak = lambda k: " ".join(r.choices([f"{w}{k}" for w in ("commonplace", "of", "the", "understanding", "and", *(f"x{j}" for j in range(200)))], weights=[40, 60, 70, 30, 50] + [1] * 200, k=100 + 9 * k))
    table = [(10 * k + j, speak(k), f"l{k}" if k else None) for k in range(6) for j in range(8)]
    table += [(900 + k, " ".join(f"none{j}" for j in range(120)), f"l{k}" if k else None) for k in range(6)]
    got = rows(quality_rules.judge(spark.createDataFrame(table, "doc_id long, text string, lang string")))
    want = brute_word_verdicts(table)
    for i, d in want.items():
        assert got[i].word_distance == pytest.approx(d, abs=1e-9)
        assert got[i].kept == (got[i].char_distance <= quality_rules.MAX_CHAR_DISTANCE and d <= 0.1 + 2.2 / np.sqrt(got[i].n_words) and not got[i].base_failed)
    assert all(got[i].kept for i in want if i < 900) and not any(got[i].kept for i in want if i >= 900)


def test_windows_of_equal_hash_are_compared(spark, monkeypatch):
    texts = ["a b c d a b c", "a b c a b d a b c", "x " * 9, "one two three four", "a b", "a b c"]
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))  # every window has the same hash
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", quality_rules.words_of(F.col("text")).alias("w"))
    got = rows(table.select("doc_id", quality_rules.repeated_words(F.col("w")).alias("n")))
    monkeypatch.setattr(F, "xxhash64", real)
    assert [got[i].n for i in range(len(texts))] == [brute_rules(t)[4] for t in texts]


def test_jensen_shannon_distance(spark):
    p, q = [3.0, 1.0, 0.0], [0.0, 1.0, 3.0]
    a, b = np.array(p) / 4, np.array(q) / 4
    m = (a + b) / 2
    kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m, strict=True) if v)
    got = spark.range(1).select(quality_rules.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d"), quality_rules.distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("e")).first()
    assert got.d == pytest.approx(np.sqrt((kl(a) + kl(b)) / 2)) and got.e == 0.0


def test_mixing(spark):
    sources = ["a"] * 5000 + ["b"] * 1500 + ["c"] * 1500 + [None] * 40
    table = spark.createDataFrame([(i, f"t{i}", s) for i, s in enumerate(sources)], "doc_id long, text string, source string").repartition(4)
    mixed = mixing.mix(table, {"a": 0.5, "b": 0.3, "c": 0.2}, block=10, period=64).collect()
    assert sorted(r.doc_id for r in mixed) == list(range(len(sources))) and len({r.mix_position for r in mixed}) == len(sources)
    blocks = {(r.source, r.mix_share, r.mix_block, r.mix_release, r.mix_deadline, r.mix_slot) for r in mixed}
    slots = {b[5]: b for b in blocks}
    assert len(slots) == len(blocks) and all(b[3] <= b[5] < b[4] for b in blocks)
    share = {b[0]: b[1] for b in blocks}
    assert sum(share.values()) == 64 and share["a"] > share["b"] > share["c"] >= 1
    had = collections.Counter()
    for t in range(300):  # before any named source runs out
        if t in slots:
            had[slots[t][0]] += 1
        for s in "abc":
            assert abs(had[s] - share[s] * (t + 1) / 64) < 1
    ordered = mixing.in_order(mixing.mix(table, block=10))
    assert ordered.columns == table.columns and ordered.count() == len(sources)


def off_by(mixed, target):
    """Largest distance of a source's blocks from its target, over all slots before it runs out."""
    slots = {(r.source, r.mix_slot) for r in mixed}
    worst = {}
    for s, w in target.items():
        mine = sorted(t for x, t in slots if x == s)
        worst[s] = max(max(abs(k - w * t), abs(k + 1 - w * (t + 1))) for k, t in enumerate(mine))
    return worst


def test_mixing_holds_the_given_weights(spark):
    weights = {"hot": 0.5, "rare": 0.0001} | {f"s{k}": 0.4999 / 198 for k in range(198)}
    sources = ["hot"] * 1500 + ["rare"] * 2 + [f"s{k}" for k in range(198) for _ in range(9)]
    table = spark.createDataFrame(list(enumerate(sources)), "doc_id long, source string").withColumn("text", F.lit("t"))
    mixed = mixing.mix(table, weights, block=1).collect()
    assert sorted(r.doc_id for r in mixed) == list(range(len(sources))) and len({r.mix_position for r in mixed}) == len(sources)
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in mixed)
    assert max(off_by(mixed, weights).values()) < 1
    assert {r.source: r.mix_weight for r in mixed} == pytest.approx(weights, rel=1e-9)


def test_mixing_schedules_every_source(spark):
    n = {f"h{k}": 4 + k % 5 for k in range(400)} | {"big": 900}
    table = spark.createDataFrame(list(enumerate(s for s, c in n.items() for _ in range(c))), "doc_id long, source string").withColumn("text", F.lit("t"))
    mixed = mixing.mix(table, block=1).collect()
    total = sum(c**0.5 for c in n.values())
    assert len({r.mix_stream for r in mixed}) == len(n) and len({r.mix_position for r in mixed}) == sum(n.values())
    assert max(off_by(mixed, {s: c**0.5 / total for s, c in n.items()}).values()) < 1
    some = mixing.mix(table, {"h0": 0.75, "h399": 0.25}, block=1).collect()
    named = [r for r in some if r.source in ("h0", "h399")]
    assert max(off_by(named, {"h0": 0.75, "h399": 0.25}).values()) < 1
    assert len(some) == sum(n.values()) and min(r.mix_slot for r in some if r not in named) > max(r.mix_slot for r in named)


def brute_scores(documents, order=3):
    """Scores by plain counting, counts of n-grams rounded down to their level."""
    count, texts = collections.Counter(), 0
    tokens = {i: [*words((t or "").translate(LOWER)), None] for i, t in documents}
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            texts += 1
            count.update((x,) for x in w)
            for n in range(2, order + 1):
                count.update(tuple(["<s>", *w][k : k + n]) for k in range(len(w) + 2 - n))
    n, v = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)
    rounded = lambda c: 1.5 ** int(np.floor(np.log(c) / np.log(1.5) + 1e-9)) if c else 0.0
    out = {}
    for i, w in tokens.items():
        s, score = ["<s>", *w], 0.0
        held = {}
        for k in range(1, len(s)):
            p, held[k, 1] = (count[s[k],] + 1) / (n + v + 1), count[s[k],]
            for m in range(2, min(order, k + 1) + 1):
                before = held[k - 1, m - 1] if k > 1 else texts
                held[k, m] = min(rounded(count[tuple(s[k + 1 - m : k + 1])]), held[k, m - 1], before)
                if before:
                    types = before**lm_scoring.TYPES
                    p = (held[k, m] + types * p) / (before + types)
            score += np.log10(p)
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(count[x,] > 0 for x in w), n, sum(np.log10((count[x,] + 1) / (n + v + 1)) for x in w), score)
    return out


@pytest.mark.parametrize(("order", "max_broadcast"), [(3, 1 << 30), (4, 0)])
def test_lm_scores(docs, order, max_broadcast):
    want = brute_scores(DOCS, order)
    got = rows(lm_scoring.score(docs, max_broadcast=max_broadcast, entry_bits=8000, order=order))
    for i, w in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert (r.base_score, r.score) == pytest.approx(w[4:], rel=1e-9)


def brute_schedule(counts, weights, block):
    """Slot by slot: of the sources whose next block is released, the one whose deadline is earliest."""
    total, had, t, out = sum(weights.values()), dict.fromkeys(counts, 0), 0, {}
    while any(had[s] * block < n for s, n in counts.items()):
        free = [s for s, n in counts.items() if had[s] * block < n and had[s] * total <= t * weights[s]]
        if free:
            s = min(free, key=lambda s: (-(-(had[s] + 1) * total // weights[s]), -counts[s], s))
            out[t] = (s, had[s])
            had[s] += 1
        t += 1
    return out


def test_mixing_is_the_schedule_slot_by_slot(spark):
    counts, weights = {"a": 90, "b": 61, "c": 40, "d": 7}, {"a": 8, "b": 4, "c": 3, "d": 1}  # a sixteenth each: exact
    table = spark.createDataFrame([(k, s, f"{s}{k % 5}", "mine", "mine") for s, n in counts.items() for k in range(n)], "doc_id long, source string, text string, __hash string, mix_slot string").repartition(4)
    mixed = mixing.mix(table, weights, block=4).collect()
    assert {r.mix_slot: (r.source, r.mix_block) for r in mixed} == brute_schedule(counts, weights, 4)
    assert len({r.mix_position for r in mixed}) == sum(counts.values()) and all(r["__hash"] == "mine" for r in mixed)


def test_blocks_grow_so_that_the_driver_orders_a_bounded_number(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 5)
    mixed = mixing.mix(spark.createDataFrame([(None, "t" * (k % 9), f"s{k % 2}") for k in range(1000)], "doc_id long, text string, source string")).collect()
    assert len({(r.source, r.mix_block) for r in mixed}) <= 5 + 2 and len({r.mix_position for r in mixed}) == 1000


def test_lm_scores_at_production_size_of_the_filter(docs):
    want, got = brute_scores(DOCS), rows(lm_scoring.score(docs))
    apart = [abs(got[i].score - w[5]) / w[1] for i, w in want.items()]
    assert max(apart) < 0.15 and np.mean(apart) < 0.02  # false positives only
    total = lambda c, held: sum(getattr(r, c) for r in got.values() if r.held_out == held)
    assert total("score", False) > total("base_score", False)


def test_log_frequency_filter(spark):
    lines = ["x y " * 40, "p q", "p q", "r s"]
    model, bits = lm_scoring.train(spark.createDataFrame([(t,) for t in lines], "text string"), entry_bits=200)
    parts = [x.model() for x in lm_scoring.share(model, bits, 40)]
    assert len(parts) > 1 and parts[0].low == 0 and parts[-1].high == 1 << bits

    def level(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        tokens, off, grams = lm_scoring.sequences(raw, np.array([0, len(raw)]))
        c, levels = lm_scoring.look_up(parts, tokens, grams)
        return c.tolist(), [x.tolist() for x in levels]

    assert level("p q") == ([2, 2, 4], [[2, 2, 2], [0, 2, 2]])
    c, (two, three) = level("x y x")
    assert c == [40, 40, 40, 4] and two[1] == 1 + int(np.log(40) / np.log(1.5)) and three[2] == 1 + int(np.log(39) / np.log(1.5))
    assert level("s r")[1] == [[0, 0, 0], [0, 0, 0]]


def test_lm_scores_know_what_was_seen_once(spark):
    kept = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(100) if i not in kept][:2]
    table = [(kept[0], "p q r s"), (kept[1], "s r q p"), (held[0], "p q r s"), (held[1], "q s p r")]
    got = rows(lm_scoring.score(spark.createDataFrame(table, "doc_id long, text string"), entry_bits=200))
    assert got[held[0]].base_score == got[held[1]].base_score and got[held[0]].score > got[held[1]].score + 1


def test_quality_classifier(spark):
    r = random.Random(9)
    good = lambda: " ".join(r.choice(WORDS) for _ in range(120))
    table, labels = [], []
    for k in range(300):
        bad = k % 3 == 0
        table.append((k, " ".join(f"{w}$#" for w in good().split()) if bad else good(), f"h{k % 5}", "spam" if bad else f"p{k % 2}"))
        if k < 200:
            labels.append((k, 0 if bad else 1))
    docs = spark.createDataFrame(table, "doc_id long, text string, host string, path string")
    out = quality_classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("host"), F.col("path")).collect()
    held = [x for x in out if x.doc_id >= 200]
    assert all(x.kept == (x.doc_id % 3 != 0) for x in held)
    by = {(x.host, x.path): x for x in out}
    assert by["h0", "spam"].path_posterior < by["h0", "spam"].host_posterior < by["h0", "p0"].path_posterior


def test_quality_posteriors(spark):
    """Every posterior and score from plain sums over the documents' own scores."""
    r = random.Random(2)
    table = [(k, " ".join(r.choices(WORDS, k=60)) + " #$" * (30 * (k % 4 == 0)), f"h{min(k % 7, 3)}" if k % 11 else None, f"p{k % 3}") for k in range(160)] + [(500, "alone", "h9", "p0"), (None, "no id", "h9", "p1")]
    labels = {k: int(k % 4 != 0) for k in range(0, 160, 2)} | {500: 1, 10_001: 0}  # the last one is of no document
    docs = spark.createDataFrame(table, "doc_id long, text string, host string, path string")
    got = quality_classifier.classify(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), F.col("host"), F.col("path")).collect()
    seen = [float(labels[x.doc_id]) if x.doc_id in labels else x.doc_score for x in got]
    strength = lambda m, v: min(1000.0, max(1.0, m * (1 - m) / v - 1 if v else 1000.0))
    mean = sum(seen) / len(seen)
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for x, s in zip(got, seen, strict=True):
        hosts[x.host].append(s)
        paths[x.host, x.path].append(s)
    avg = lambda v: sum(v) / len(v)
    alpha = strength(mean, sum(len(v) * (avg(v) - mean) ** 2 for v in hosts.values()) / len(seen))
    posterior = {h: (alpha * mean + sum(v)) / (alpha + len(v)) for h, v in hosts.items()}
    beta = strength(mean, sum(len(v) * (avg(v) - posterior[h]) ** 2 for (h, _), v in paths.items()) / len(seen))
    odds = lambda p: np.log(min(0.999, max(0.001, p)) / (1 - min(0.999, max(0.001, p))))
    for x, s in zip(got, seen, strict=True):
        host, path = hosts[x.host], paths[x.host, x.path]
        assert x.host_posterior == pytest.approx(posterior[x.host]) and x.path_posterior == pytest.approx((beta * posterior[x.host] + sum(path)) / (beta + len(path)))
        rest = (sum(seen) - s) / (len(seen) - 1)
        others = (beta * (alpha * rest + sum(host) - s) / (alpha + len(host) - 1) + sum(path) - s) / (beta + len(path) - 1)
        assert x.score == pytest.approx(1 / (1 + np.exp(-(odds(x.doc_score) + 0.5 * (odds(others) - odds(rest))))))
        assert x.kept == (x.score >= quality_classifier.KEEP_AT)


def test_labels_of_absent_documents_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(k, "good words here" if k % 2 else "### $$$") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(5000)], "doc_id long, label int")
    assert quality_classifier.train(docs, labels, sample=40) is not None


def test_ids_beyond_16_bits():
    cache = K.PieceCache(tokenizer("byte_bpe_50k.json"))
    ids, _ = cache.encode(np.frombuffer(b"some text", np.uint8), np.array([0, 9]), 70_000)
    assert ids[-1] == 70_000 and ids[:-1].tolist() == cache.lib.model.encode("some text").ids
    cache.lib.dtype = np.uint32
    cache.clear()
    cache.lib.encode = lambda pieces, first: [[100_000 + len(p)] for p in pieces]
    assert cache.encode(np.frombuffer(b"some text", np.uint8), np.array([0, 9]), 2)[0].tolist() == [100_004, 100_005, 2]


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    base = [(1000 + k, " ".join(r.choice(WORDS) for _ in range(120)), "en", "s1") for k in range(30)]
    copies = [(2000 + k, base[k][1], "en", "s2") for k in range(5)] + [(3000, base[7][1] + " tail", "en", "s2")]
    table = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame([*base, *copies], "doc_id long, text string, lang string, source string"))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = {x.doc_id for x in quality_rules.judge(table).where("kept").collect()}
    texts = {x.doc_id: x.text for x in table.collect()}
    groups = collections.defaultdict(list)
    for i in good:
        groups[re.sub(SPACE + "+", " ", texts[i] or "")].append(i)
    left = [(min(g), texts[min(g)]) for g in groups.values()]
    want = {c for _, c in brute_components(left).values()}
    assert {x.doc_id for x in out} == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_duplicates", "mixing", "packing"]
