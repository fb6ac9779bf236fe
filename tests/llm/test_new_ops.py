"""Merkle manifests, toxicity and spelling variants against brute force on small fixtures with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import _bytes as B
from folio.llm import merkle, spelling, toxicity

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, hash string, tree string, word string, label int, `index` int"


def documents(spark, table):
    """Rows (doc_id, text, lang, source, n_chars) with further columns that the operators name themselves."""
    return spark.createDataFrame([(*r, "x", "y", "z", 7, 3) for r in table], DOCUMENT).repartition(3)


AWKWARD = [(None, "no id", None, None, None), (None, "no id", None, None, None), (5, None, "en", "a", None), (5, "twice", "en", "a", 5), (5, "twice", "en", "a", 5), (9, "", "", "", 0), (2**53 + 1, "large id", "en", "a", 8), (2**53 + 2, "large id", "en", "a", 8)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    i, text, lang, source, chars = r
    return sha("".join(map(field, (i, source, lang, None if chars is None else chars + more, text))))


def path(nodes, i, fanout):
    """The siblings of node ``i``, level by level, and the root."""
    out = []
    while len(nodes) > 1:
        k = i - i % fanout
        out += nodes[k:i] + nodes[i + 1 : k + fanout]
        nodes, i = [sha("".join(nodes[j : j + fanout])) for j in range(0, len(nodes), fanout)], i // fanout
    return out, nodes[0]


def brute_manifest(table, fanout):
    trees = collections.defaultdict(list)
    for r in table:
        trees[r[2]].append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for rows in trees.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    roots = [path([leaf(r) for r in trees[x]], 0, fanout)[1] for x in names]
    out = []
    for k, x in enumerate(names):
        upper, root = path(roots, k, fanout)
        for i, r in enumerate(trees[x]):
            lower, subroot = path([leaf(q) for q in trees[x]], i, fanout)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            out.append((r[0], leaf(r), subroot, root, sha("".join(lower + upper)), not hit))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout,levels,langs", [(2, 2, 5), (3, 1, 5), (2, 10, 1), (2, 3, 20)])
def test_manifest(spark, fanout, levels, langs):
    r = random.Random(fanout * levels)
    table = [(k * 7, "".join(r.choices("abé ", k=r.randint(0, 9))), f"l{k % 3 and k % langs}", "s", k) for k in range(90)] + AWKWARD
    got = merkle.manifest(merkle.tampered_documents(documents(spark, table)), fanout, levels).collect()
    want = brute_manifest(table, fanout)
    assert sorted([(x.doc_id, x.leaf, x.subroot, x.root, x.proof_sha256, x.verified) for x in got], key=repr) == want
    assert all((x.folded_root == x.root) == x.verified for x in got)


def test_manifest_of_trees_of_one_row_and_of_nothing(spark):
    table = [(k, "t", f"l{k}", "s", 1) for k in range(5)]
    got = merkle.manifest(merkle.leaves(documents(spark, table), ("doc_id", "source", "lang", "n_chars", "text"))).collect()
    assert {(x.leaf, x.root) for x in got} == {(leaf(r), path([leaf(q) for q in table], 0, 2)[1]) for r in table}
    assert all(x.leaf == x.subroot and x.verified for x in got)
    one = merkle.manifest(merkle.leaves(documents(spark, table[:1]), ("doc_id", "source", "lang", "n_chars", "text"))).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")
    assert merkle.manifest(merkle.tampered_documents(documents(spark, table).where("false"))).count() == 0


def test_proofs_verify_and_forgeries_do_not(spark):
    table = [(k, f"text {k}", f"l{k % 3}", "s", k) for k in range(40)]
    for x in merkle.manifest(merkle.leaves(documents(spark, table), ("doc_id", "text")), levels=2, with_proof=True).collect():
        places = [(x["index"], x["size"]), (x["rank"], x["trees"])]
        assert merkle.fold(x.leaf, places, x.proof, 2) == x.root
        assert merkle.fold(sha("forged"), places, x.proof, 2) != x.root
        assert merkle.fold(x.leaf, places, x.proof[64:] + x.proof[:64], 2) != x.root


def brute_variants(table, one_in, least_length=5, least_count=3):
    count = collections.Counter()
    for i, text, *_ in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if one_in and h % one_in == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in words if apart(v, w)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def variant_table():
    r = random.Random(8)
    stems = ["banana", "aaaaa", "colour", "münchen", "ÀÉÎõü", "strasse", "x" * 90]
    table = []
    for k in range(150):
        said = []
        for _ in range(30):
            w = r.choice(stems)
            for _ in range(r.choice((0, 0, 0, 1, 2))):
                p = r.randrange(len(w))
                w = r.choice((w[:p] + w[p + 1 :], w[:p] + r.choice("abzé×") + w[p:], w[:p] + r.choice("abzé÷") + w[p + 1 :]))
            said.append(w.upper() if r.random() < 0.1 else w)
        table.append((k, " ".join(said) + "1it's,", "en", "s", 1))
    return table + [(None, "banana " * 4, "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1), (4, "банан 한국어 " * 5, "en", "s", 1), (7, "colour," * 4000, "en", "s", 1)]


@pytest.mark.parametrize("one_in,stretch", [(None, 1 << 16), (5, 7)])
def test_spelling_groups(spark, monkeypatch, one_in, stretch):
    monkeypatch.setattr(spelling, "STRETCH", stretch)
    table = variant_table()
    got = {tuple(x) for x in spelling.spelling_groups(documents(spark, table), one_in=one_in).collect()}
    want = brute_variants(table, one_in)
    assert got == want and len({x[2] for x in want}) < len(want)


def test_colliding_keys_join_nothing(spark, monkeypatch):
    """With all keys alike, only the strings decide."""
    table = variant_table()[:40]
    monkeypatch.setattr(spelling, "RADIX_BITS", 1)
    counted = spelling.words(spelling.runs(documents(spark, table)).select(F.col("run").alias("word")), 5, 3)
    every = counted.selectExpr("id", "explode(sequence(-1, char_length(word) - 1)) as place", "word").selectExpr("id", "place", "explode(array(true, false)) as replaced", "word")
    every = every.where("not replaced or place >= 0").where("place < 1 or substr(word, place + 1, 1) <> substr(word, place, 1) or replaced").select("replaced", "place", "id")
    monkeypatch.setattr(spelling, "members", lambda words_: every)
    assert {tuple(x) for x in spelling.variants(counted).collect()} == brute_variants(table, None)


def test_deletion_keys_are_the_hashes_of_shortened_words():
    words = ["aab", "été", "b", "ÿ" * 40]
    raw = [w.encode() for w in words]
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    key, place, word, first = spelling.deletion_keys(*spelling.latin(buf, offsets))
    own = {}
    for w in {w[:p] + w[p + 1 :] for w in words for p in range(-1, len(w)) if p >= 0} | set(words):
        b = np.frombuffer(w.encode("latin-1"), np.uint8)
        own[w] = int(B.span_hash(B.prefix_hash(b), np.array([0]), np.array([len(b)]))[0])
    for k, p, w, f in zip(key.tolist(), place.tolist(), word.tolist(), first.tolist(), strict=True):
        text = words[w]
        assert k == own[text if p < 0 else text[:p] + text[p + 1 :]]
        assert f == (p < 1 or text[p] != text[p - 1])


def test_spelling_of_nothing(spark):
    assert spelling.spelling_groups(documents(spark, AWKWARD).where("false")).count() == 0
    assert spelling.spelling_groups(documents(spark, AWKWARD), one_in=97).count() == 0


def toxic_table(n=400):
    r = random.Random(12)
    plain = ["thore", "enda", "über", "ciera", "of", "the", "lieu", "étan"]
    bad = ["vilify", "grumbo", "grumbos", "grumbast", "zähesk"]
    table, labels, where = [], [], {}
    for k in range(n):
        said = [" ".join(r.choices(plain, k=8)) for _ in range(6)]
        if k % 4 == 0:
            p = r.randrange(6)
            said[p] += " " + r.choice(bad) + " " + r.choice(plain)
            where[k] = p
        table.append((k, ". ".join(said) + ".", "en", "s", 1))
        labels.append((k, int(k % 4 == 0) if r.random() > 0.03 else 1))
    return table, labels, where


def test_toxicity(spark):
    table, labels, where = toxic_table()
    docs = documents(spark, [*table, *AWKWARD])
    known = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.classify(docs, known).collect()
    assert len(got) == len(table) + len(AWKWARD)
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5)
    held = {x.doc_id: x.predicted for x in got if x.held_out and x.doc_id < len(table)}
    assert len(held) > 40 and held == {i: int(i % 4 == 0) for i in held}
    assert all(x.score == 0 and x.n_offending == 0 for x in got if x.doc_id not in range(len(table)))
    model = toxicity.train(docs, known)
    found = toxicity.offending(docs, model).collect()
    assert {(x.doc_id, x.sentence) for x in found} == {(k, table[k][1].split(". ")[p].rstrip(".") + ".") for k, p in where.items()}
    text = {r[0]: (r[1] or "").encode() for r in table}
    assert all(text[x.doc_id][x.start :].decode("utf-8").strip().startswith(x.sentence) for x in found)
    assert not {x.doc_id for x in toxicity.score(docs, model).where("n_offending > 0").collect()} - set(where)


def test_held_out_labels_teach_nothing(spark):
    """Wrong labels of held-out rows change no score."""
    table, labels, _ = toxic_table(200)
    docs, held = documents(spark, table), lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    wrong = [(i, 1 - y if held(i) else y) for i, y in labels]
    scores = [{x.doc_id: x.score for x in toxicity.classify(docs, spark.createDataFrame(y, "doc_id long, toxic int")).collect()} for y in (labels, wrong)]
    assert scores[0] == pytest.approx(scores[1])


def test_noisy_or_and_its_gradient():
    p, bag = np.array([0.5, 0.5, 0.2]), np.array([0, 0, 2])
    assert toxicity.noisy_or(p, bag, 3).tolist() == pytest.approx([0.75, 0.0, 0.2])
    # Two bags: label 1 with sentences {0, 1} and {1}, label 0 with sentence {0}; one more sentence without features in each.
    args = (np.array([1, 0]), np.array([3, 2]), np.array([3, 1]), np.array([0, 0, 1, 0]), np.array([0, 1, 1, 0]))
    at = lambda w: toxicity.Model(np.arange(2), np.array(w[:2]), w[2], 0.1)

    def loss(w):
        q = [1 / (1 + np.exp(-x)) for x in (w[2] + w[0] + w[1], w[2] + w[1], w[2], w[2] + w[0])]
        first = 1 - 0.9 * (1 - q[0]) * (1 - q[1]) * (1 - q[2])
        return np.log(first) + np.log(0.9 * (1 - q[3]) * (1 - q[2]))

    w = np.array([0.3, -0.4, -1.0])
    got = toxicity._sums(*args, at(w))
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert (got[:2].tolist() + [got[4]])[k] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, rel=1e-4)


def test_one_kind_of_label_gives_no_score(spark):
    table, labels, _ = toxic_table(40)
    out = toxicity.classify(documents(spark, table), spark.createDataFrame([(i, 1) for i, _ in labels], "doc_id long, toxic int"))
    assert {x.score for x in out.collect()} == {0.0}
    assert toxicity.classify(documents(spark, table).where("false"), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
