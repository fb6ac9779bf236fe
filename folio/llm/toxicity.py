"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A document is a bag of sentences.  A sentence has the probability
sigmoid(bias + sum of the weights of its words' features), and a document is toxic
unless none of its sentences is: 1 - product(1 - p), the noisy-or.  A leak, a chance
that the label has another cause than a sentence, is part of the model while it learns,
so labels that no sentence explains do not bend the weights.

Features are words (runs of letters, A-Z lower-cased) and their first 4 to 7 letters,
so inflected forms share evidence.  Of those in the labelled rows, the ``FEATURES`` with
the largest likelihood ratio for toxic labels are kept, found by one grouped count
over at most ``SAMPLE`` rows.  The weights are learnt by EM: each step is one Spark job over the bags
of the sample (kept in the shared folder, features only), in which every task adds up
its responsibilities, gradients and curvatures; only those sums, as long as the model,
reach the driver.  No text does.

Every text is then scored sentence by sentence with the weights (a sorted table of
at most ``FEATURES`` hashes) and ``offending`` lists the sentences at or above a threshold.

Defined cases: null text is empty, and an empty text has the score of no sentence (0);
repeated or null ``doc_id`` values are scored row by row; a label counts for every row of its
id (given twice, its mean, rounded half up), and null labels and ids are left out; without
labels of both kinds, or without a feature that tells them apart, every score is 0; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm import _bytes as B
from folio.session import keep, ship

#: Labelled rows that the model is fitted on (those with the smallest id hash), features of the model, and least likelihood ratio of a feature.
SAMPLE, FEATURES, LEAST_RATIO = 16384, 4096, 24.0
#: A feature occurs in so many toxic documents at least.
SUPPORT = 4
#: Lengths of word beginnings, in letters.
HEADS = (4, 5, 6, 7)
STEPS, RIDGE, BIAS = 16, 0.5, -8.0
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


class Model(NamedTuple):
    """Sorted feature hashes, their weights, the bias of a sentence, and the leak of a document."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float


def held_out(key: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def sentences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each sentence: up to a full stop, exclamation or question mark or line feed, with a letter in it."""
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:] |= _END[buf]
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    seen = np.zeros(n + 1, np.int64)
    np.cumsum(_LETTER[buf], out=seen[1:])
    filled = seen[end] > seen[start]
    start, end = start[filled], end[filled]
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def features(buf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of all words, and the sentence of each; sentences begin at ``start``, and no word crosses one."""
    letter = _LETTER[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    first = np.zeros(len(buf), bool)
    first[start] = True
    stop = np.ones(len(buf), bool)
    stop[:-1] = first[1:]
    begin = np.flatnonzero(letter & (~before | first))
    end = np.flatnonzero(letter & (~after | stop)) + 1
    prefix = B.prefix_hash(B.LOWER[buf])
    of = np.searchsorted(start, begin, side="right") - 1
    chars = np.flatnonzero((buf & 0xC0) != 0x80)
    at = np.searchsorted(chars, begin)
    chars = np.append(chars, len(buf))
    out, owner = [B.span_hash(prefix, begin, end)], [of]
    for k in HEADS:
        head = chars[np.minimum(at + k, len(chars) - 1)]
        longer = np.flatnonzero(head < end)
        out.append(B.mix(B.span_hash(prefix, begin[longer], head[longer]) ^ B.COMBINE[0]))
        owner.append(of[longer])
    return np.concatenate(out), np.concatenate(owner)


def _known(labels: DataFrame, key: str, label: str) -> DataFrame:
    held = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull())
    return held.groupBy(F.col(f"`{key}`").cast("long").alias("__id")).agg(F.floor(F.avg(f"`{label}`") + 0.5).cast("int").alias("label"))


def _sample(rows: DataFrame, known: DataFrame, sample: int) -> DataFrame:
    """(doc, label, text) of at most ``sample`` labelled rows."""
    ids = rows.where("doc_id is not null").select("doc_id").distinct()
    chosen = known.join(ids, F.col("__id") == F.col("doc_id"), "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(sample)
    got = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("label", "text")
    # Repeated ids can give more rows than labels, and copies of one text tell no more than one.
    return got.groupBy(F.sha2("text", 256).alias("doc"), "label").agg(F.first("text").alias("text")).limit(sample)


def informative(sample: DataFrame, count: int = FEATURES) -> np.ndarray:
    """Sorted hashes of the features that tell toxic documents of ``sample`` best from the others."""
    ship(sample.sparkSession)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in B.chunks(batch, "text"):
                start, _, row = sentences(buf, offsets)
                if not len(start):
                    continue
                h, of = features(buf, start)
                label = part.column("label").to_numpy()[row[of]]
                _, once = np.unique(h ^ B.mix(row[of].astype(np.uint64)), return_index=True)
                h, label = h[once], label[once]
                kinds, inverse = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.bincount(inverse)), pa.array(np.bincount(inverse, weights=label).astype(np.int64))], ["feature", "n", "k"])

    sizes = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")).first()
    whole, toxic = sizes["n"], sizes["k"] or 0
    if not 0 < toxic < whole:
        return np.zeros(0, np.uint64)
    found = sample.mapInArrow(distinct, "feature long, n long, k long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where(F.col("k") >= SUPPORT)
    base = toxic / whole
    n, k = F.col("n"), F.col("k")
    xlog = lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0)
    ratio = 2 * (xlog(k, n * base) + xlog(n - k, n * (1 - base)))
    best = found.where((k / n > base) & (ratio >= LEAST_RATIO)).orderBy(F.desc(ratio), "feature").limit(count)
    return np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int64).view(np.uint64))  # at most ``count``


def _places(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = np.flatnonzero(known[at] == h)
    return hit, at[hit]


def _bags(sample: DataFrame, known: np.ndarray) -> DataFrame:
    """(label, n, sentence, feature): of each text the number of sentences, and the features of the model by sentence (numbered from 0 where they have any)."""
    schema = "label int, n int, sentence array<int>, feature array<int>"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in B.chunks(batch, "text"):
                start, _, row = sentences(buf, offsets)
                h, of = features(buf, start) if len(start) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                hit, at = _places(known, h)
                order = np.argsort(of[hit], kind="stable")
                of, at = of[hit][order], at[order]
                _, number = np.unique(of, return_inverse=True)
                cut = np.searchsorted(row[of] if len(of) else of, np.arange(len(offsets)))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x.astype(np.int32))) for x in (number, at)]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(np.bincount(row, minlength=len(offsets) - 1).astype(np.int32)), *lists], ["label", "n", "sentence", "feature"])

    return keep(sample.mapInArrow(make, schema), "bags")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def noisy_or(p: np.ndarray, bag: np.ndarray, bags: int, rest: np.ndarray | float = 0.0) -> np.ndarray:
    """1 - product(1 - p) by bag; ``rest`` is the log of a further factor."""
    return np.maximum(0.0, -np.expm1(np.bincount(bag, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=bags) + rest))


def _sums(label: np.ndarray, n: np.ndarray, sizes: np.ndarray, sentence: np.ndarray, feature: np.ndarray, model: Model) -> np.ndarray:
    """Gradient and curvature of every weight and the bias, the leak's responsibility, and the number of texts."""
    width, bags = len(model.weights), len(label)
    bag = np.repeat(np.arange(bags), sizes)
    new = np.ones(len(sentence), bool)
    new[1:] = (sentence[1:] != sentence[:-1]) | (bag[1:] != bag[:-1])
    of = np.cumsum(new) - 1
    owner = bag[new]
    p = _sigmoid(model.bias + np.bincount(of, weights=model.weights[feature], minlength=len(owner)))
    plain, base = n - np.bincount(owner, minlength=bags), _sigmoid(np.array(model.bias))
    whole = noisy_or(p, owner, bags, plain * np.log1p(-base) + np.log1p(-model.leak))
    toxic = label > 0
    share = np.where(toxic, 1 / np.maximum(whole, 1e-12), 0.0)
    gap, curve = p * share[owner] - p, p * (1 - p)
    bias_gap = gap.sum() + (plain * base * (share - 1)).sum()
    return np.concatenate([np.bincount(feature, weights=gap[of], minlength=width), np.bincount(feature, weights=curve[of], minlength=width), [bias_gap, curve.sum() + (plain * base * (1 - base)).sum(), (model.leak * share).sum(), bags]])


def fit(sample: DataFrame, count: int = FEATURES, steps: int = STEPS) -> Model:
    """The model of (doc, label, text) rows."""
    known = informative(sample, count)
    model = Model(known, np.full(len(known), 1.0), BIAS, 0.05)
    if not len(known):
        return model
    bags, width = _bags(sample, known), len(known)
    for _ in range(steps):

        def add(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * width + 4)
            for b in batches:
                lists = b.column("sentence")
                total += _sums(b.column("label").to_numpy(), b.column("n").to_numpy(), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), b.column("feature").flatten().to_numpy(), model)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "x"])

        got = bags.mapInArrow(add, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # two numbers for each weight
        total = np.zeros(2 * width + 4)
        total[got.column("at").to_numpy()] = got.column("x").to_numpy()
        gap, curve, (bias_gap, bias_curve, leaked, texts) = total[:width], total[width : 2 * width], total[2 * width :]
        weights = model.weights + np.clip((gap - RIDGE * model.weights * 0.1) / (curve + RIDGE), -2, 2)
        bias = float(np.clip(model.bias + np.clip(bias_gap / (bias_curve + RIDGE), -1, 1), -14, -3))
        model = Model(known, weights, bias, float(np.clip(leaked / max(texts, 1), 1e-4, 0.2)))
    return model


def _sentence_scores(buf: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, row = sentences(buf, offsets)
    x = np.full(len(start), model.bias)
    if len(start) and len(model.features):
        h, of = features(buf, start)
        hit, at = _places(model.features, h)
        x += np.bincount(of[hit], weights=model.weights[at], minlength=len(start))
    return start, end, row, _sigmoid(x)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", where: Column | None = None, sample: int = SAMPLE) -> Model:
    """A model from the labels of ``docs``; ``where`` (over ``doc_id``) says which rows may teach."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows if where is None else rows.where(where)
    return fit(keep(_sample(rows, _known(labels, key, label), sample), "labelled"))


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, score, n_sentences, n_offending (score of at least a half) and worst_start, worst_length (bytes; null without sentences) of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 16 bytes for each of at most FEATURES features

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, buf, offsets in B.chunks(batch, "text"):
                rows = len(offsets) - 1
                start, end, row, p = _sentence_scores(buf, offsets, model)
                # A sentence without a feature says nothing; its base rate would only count how long a text is.
                said = p > _sigmoid(np.array(model.bias)) * 1.0001
                total = noisy_or(p[said], row[said], rows)
                worst = np.full(rows, -1)
                order = np.lexsort((-start, p))
                worst[row[order]] = order
                none = worst < 0
                at = np.where(none, 0, worst)
                begin = start[at] - offsets[:-1] if len(start) else at
                length = (end - start)[at] if len(start) else at
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(total), pa.array(np.bincount(row, minlength=rows)), pa.array(np.bincount(row[p >= 0.5], minlength=rows)), pa.array(begin, pa.int64(), mask=none), pa.array(length, pa.int64(), mask=none)],
                    ["doc_id", "score", "n_sentences", "n_offending", "worst_start", "worst_length"],
                )

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, score double, n_sentences long, n_offending long, worst_start long, worst_length long")


def offending(docs: DataFrame, model: Model, at_least: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, sentence, score) of every sentence with that score: ``start`` in UTF-8 bytes."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in B.chunks(batch, "text"):
                start, end, row, p = _sentence_scores(buf, offsets, shared.value)
                hit = np.flatnonzero(p >= at_least)
                raw = [buf[s:e].tobytes().decode("utf-8", "replace").strip() for s, e in zip(start[hit].tolist(), end[hit].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row[hit])), pa.array(start[hit] - offsets[row[hit]]), pa.array(raw, pa.string()), pa.array(p[hit])], ["doc_id", "start", "sentence", "score"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(find, "doc_id long, start long, sentence string, score double")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", folds: int = 5) -> DataFrame:
    """Learn from the rows that are not held out (crc32 of the id, modulo ``folds``), and score every row."""
    model = train(docs, labels, text, key, label, ~held_out(F.col("doc_id"), folds))
    judged = score(docs, model, text, key)
    return judged.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_offending", "worst_start", "worst_length")
