"""Quality scores by hierarchical empirical Bayes.

A logistic model over text statistics and hashed words gives each document its own
evidence.  It is fitted on at most ``SAMPLE`` labelled documents (a documented bound;
of those in the table, the ones with the smallest id hash); everything after it covers
all documents.
Evidence (the label where there is one, else the model's probability) is summed by
path and by host.  A host's posterior shrinks its mean toward the global mean with a
prior strength fitted by moments, and a path's posterior shrinks toward its host's in
the same way, so a site with few documents says little.  The final odds are the
document's odds times the ratio of its path's odds to the global odds, raised to
``SITE_WEIGHT``; the document itself is taken out of its path, its host and the whole
for that ratio, so it never votes for itself.

Hosts and paths are summed map-side first; their posteriors come back by
``_skew.attach``, so a host with a third of all rows is no hot key.

Defined cases: null text counts as empty; null hosts and paths are groups of their
own; repeated ``doc_id`` values are scored row by row (a label given twice counts as
its mean, rounded half up); without labels of both kinds the model gives 0.5 and all
documents are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm import _bytes as B
from folio.llm._skew import attach
from folio.session import keep, ship

#: Labelled rows used for fitting, at most; hashed word features; least score kept.
SAMPLE, BUCKETS, KEEP_AT = 8192, 512, 0.25
SITE_WEIGHT, RIDGE = 0.5, 1.0
_CLASSES = np.zeros((5, 256), np.int8)
_CLASSES[0, 65:91] = 1
_CLASSES[1, 48:58] = 1
_CLASSES[2, list(b"#*$%&|<>!@^~=+_{}[]\\/")] = 1
_CLASSES[3, list(b" \t\n\x0b\x0c\r")] = 1
_CLASSES[4, 128:] = 1
WIDTH = BUCKETS + 12


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of WIDTH numbers per text."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    starts, ends, row = B.words(buf, offsets)
    h = B.span_hash(B.prefix_hash(B.LOWER[buf]), starts, ends)
    n = np.bincount(row, minlength=rows)
    safe, letters = np.maximum(n, 1), np.maximum(size, 1)
    out = np.zeros((rows, WIDTH), np.float32)
    tf = np.bincount(row * BUCKETS + (h >> np.uint64(55)).astype(np.int64), minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    out[:, :BUCKETS] = np.sqrt(tf / safe[:, None])
    for k, table in enumerate(_CLASSES):
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(table[buf], out=total[1:])
        out[:, BUCKETS + k] = (total[offsets[1:]] - total[offsets[:-1]]) / letters
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    distinct = np.unique(h ^ B.mix(row.astype(np.uint64)))
    owner = np.bincount(row[np.unique(h ^ B.mix(row.astype(np.uint64)), return_index=True)[1]], minlength=rows) if len(distinct) else np.zeros(rows)
    length = (ends - starts).astype(np.float64)
    extra = (np.log1p(n) / 8, np.bincount(row, weights=length, minlength=rows) / safe / 10, np.bincount(row, weights=same, minlength=rows) / safe, owner / safe, np.bincount(row, weights=length > 20, minlength=rows) / safe, (n < 20) * 1.0, np.ones(rows))
    for k, x in enumerate(extra, len(_CLASSES)):
        out[:, BUCKETS + k] = x
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray | None:
    """Ridge logistic regression by Newton steps; None without both classes."""
    if len(y) == 0 or y.min() == y.max():
        return None
    x = x.astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Model weights from labelled rows; ``rows`` has doc_id and text, ``labels`` has doc_id and label."""
    ship(rows.sparkSession)
    present = labels.join(rows.select(F.col("doc_id").alias("__id")).distinct(), F.col("doc_id") == F.col("__id"), "left_semi")
    chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most SAMPLE rows

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in B.chunks(batch, "text"):
                x = features(buf, offsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    got = rows.join(F.broadcast(chosen.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "label").mapInArrow(describe, "doc_id long, label int, x binary")
    # Repeated ids can give more rows than labels; the same bound holds for what is collected.
    found = got.orderBy("doc_id", "label", "x").limit(sample).collect()
    if not found:
        return None
    return fit(np.frombuffer(b"".join(bytes(r["x"]) for r in found), np.float32).reshape(len(found), WIDTH), np.array([r["label"] for r in found], np.float64))


def _strength(mean: Column, spread: Column) -> Column:
    """Prior strength by moments: m(1-m)/v - 1, within [1, 1000]."""
    return F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.coalesce(F.try_divide(mean * (1 - mean), spread) - 1, F.lit(1000.0))))


def _odds(p: Column) -> Column:
    p = F.least(F.lit(0.999), F.greatest(F.lit(0.001), p))
    return F.ln(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", key: str = "doc_id", label: str = "quality", keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, host, path, doc_score, host_posterior, path_posterior, score, kept for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.floor(F.avg(label) + 0.5).cast("int").alias("label"))
    weights = train(rows, known)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in B.chunks(batch, "text"):
                p = np.full(len(offsets) - 1, 0.5) if weights is None else 1 / (1 + np.exp(-np.clip(features(buf, offsets) @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), part.column("path"), pa.array(p)], ["doc_id", "host", "path", "doc_score"])

    scored = rows.mapInArrow(evidence, "doc_id long, host string, path string, doc_score double")
    scored = scored.join(known.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left").drop("__id")
    scored = keep(scored.withColumn("seen", F.coalesce(F.col("label").cast("double"), F.col("doc_score"))), "evidence")

    paths = keep(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("seen").alias("s")), "paths")
    hosts = keep(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "hosts")
    overall = hosts.agg(F.sum("hn").alias("gn"), (F.sum("hs") / F.sum("hn")).alias("m")).first()
    total, mean = overall["gn"] or 0, overall["m"] if overall["m"] is not None else 0.5
    m = F.lit(float(mean))
    host_mean = F.col("hs") / F.col("hn")
    between = F.sum(F.col("hn") * (host_mean - m) * (host_mean - m)) / F.sum("hn")
    alpha = float(hosts.agg(_strength(m, between).alias("a")).first()["a"] or 1000.0)
    hosts = hosts.select(F.col("host").alias("__host"), "hn", "hs", ((F.lit(alpha) * m + F.col("hs")) / (F.lit(alpha) + F.col("hn"))).alias("host_posterior"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("__host"))).drop("__host")
    inner = F.col("s") / F.col("n")
    within = F.sum(F.col("n") * (inner - F.col("host_posterior")) * (inner - F.col("host_posterior"))) / F.sum("n")
    sites = keep(sites.select("host", "path", "n", "s", "hn", "hs", "host_posterior"), "sites")
    beta = float(sites.agg(_strength(m, within).alias("b")).first()["b"] or 1000.0)

    joined = attach(scored, sites, ["host", "path"], "n", total)
    posterior = (F.lit(beta) * F.col("host_posterior") + F.col("s")) / (F.lit(beta) + F.col("n"))
    # The same three means without the document itself.
    without = F.coalesce(F.try_divide(F.lit(float(mean) * total) - F.col("seen"), F.lit(total - 1.0)), m)
    host_others = (F.lit(alpha) * without + F.col("hs") - F.col("seen")) / (F.lit(alpha) + F.col("hn") - 1)
    others = (F.lit(beta) * host_others + F.col("s") - F.col("seen")) / (F.lit(beta) + F.col("n") - 1)
    final = 1 / (1 + F.exp(-(_odds(F.col("doc_score")) + F.lit(SITE_WEIGHT) * (_odds(others) - _odds(without)))))
    return joined.select("doc_id", "host", "path", "doc_score", "host_posterior", posterior.alias("path_posterior"), final.alias("score")).withColumn("kept", (F.col("score") >= keep_at) | F.lit(weights is None))
