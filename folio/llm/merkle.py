"""A Merkle manifest of a table, with a proof for every row, by superblock reduction.

A row's leaf is the sha256 of its columns, each ``-`` if null and else its UTF-8 byte
count, ``:`` and its value.  The leaves of a tree (here a language) are numbered in
order without gathering a tree in one task: a range shuffle of digests, then prefix
sums over (partition, tree).  Indices are bucketed by fanout**LEVELS; a grouped map
collapses LEVELS levels of every bucket into its root, and the bucket roots are reduced
in the same way until each tree has one node, its subroot.  The subroots, ordered by
tree, are a tree themselves.  Proofs come back from the top: every bucket gets the
proof of its root (its upper part) by cogroup, works out the lower part of its own nodes,
and joins the two.

Every stage is a table in the shared folder, a bucket has at most fanout**LEVELS nodes,
and texts are only hashed.  ``verify`` folds a row's claimed leaf along its proof.

Defined cases: a null tree key comes first and is a tree of its own; rows of a tree
ascend by key (null first), then by leaf, and rows equal in both stand in any order; a
tree of one row has its leaf as subroot and an empty part of the proof; an empty table
has no rows and no root; columns that are not hashed are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.session import keep, ship

#: Levels that one bucket collapses: 1024 nodes with a fanout of 2.
LEVELS = 10


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def canonical(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(canonical, columns)), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``index`` (from 0, in ``order`` inside their ``tree``) and ``size`` (rows of the tree)."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())  # many equal rows are no single range
    laid = tied.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie")
    laid = keep(laid.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "laid")
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = laid.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    spans = spans.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    return keep(laid.join(spans, ["tree", "part"]).withColumn("index", F.col("at") + F.col("shift")).drop("at", "part", "shift"), "nodes")


def runs(nodes: list[str], fanout: int) -> list[str]:
    """The next level: every ``fanout`` consecutive nodes (last run: fewer) become their hash."""
    return [h("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]


def collapse(nodes: list[str], size: int, levels: int, fanout: int) -> tuple[str, list[str]]:
    """The root of one bucket after ``levels`` levels, or when the tree of ``size`` nodes has but one, and each node's siblings on the way, as one text."""
    proofs, at = [""] * len(nodes), list(range(len(nodes)))
    while levels and size > 1:
        for i, k in enumerate(at):
            first = k - k % fanout
            proofs[i] += "".join(nodes[first:k] + nodes[k + 1 : first + fanout])
            at[i] = k // fanout
        nodes, size, levels = runs(nodes, fanout), -(-size // fanout), levels - 1
    return nodes[0], proofs


def fold(node: str, places: list[tuple[int, int]], proof: str, fanout: int) -> str:
    """The root that ``node`` leads to: ``places`` are (index, size) in each tree on the way, ``proof`` the siblings."""
    used = 0
    for index, size in places:
        while size > 1:
            k, first = index % fanout, index - index % fanout
            others = min(fanout, size - first) - 1
            around = proof[used : used + 64 * others]
            node = h(around[: 64 * k] + node + around[64 * k :])
            used += 64 * others
            index, size = index // fanout, -(-size // fanout)
    return node


_NODE = "tree string, index long, size long, hash string"
_ABOVE = "proof string, subroot string, root string, rank long, trees long"


def _bucketed(nodes: DataFrame, levels: int, fanout: int) -> DataFrame:
    return nodes.withColumn("bucket", F.floor(F.col("index") / fanout**levels).cast("long"))


def _roots(nodes: DataFrame, levels: int, fanout: int) -> DataFrame:
    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        size = int(pdf["size"].iloc[0])
        root, _ = collapse(pdf["hash"].tolist(), size, levels, fanout)
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "index": pdf["bucket"].iloc[:1], "size": -(-size // fanout**levels), "hash": root})

    return keep(_bucketed(nodes.select("tree", "index", "size", "hash"), levels, fanout).groupBy("tree", "bucket").applyInPandas(reduce, _NODE), "roots")


def _proved(nodes: DataFrame, above: DataFrame, levels: int, fanout: int, finish: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``nodes`` with what ``above`` says of their buckets (tree, index), and the whole proof of each."""

    def lower(mine: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("index", ignore_index=True)
        _, proofs = collapse(mine["hash"].tolist(), int(mine["size"].iloc[0]), levels, fanout)
        mine["proof"] = [p + top["proof"].iloc[0] for p in proofs]
        for c in ("subroot", "root", "rank", "trees"):
            mine[c] = top[c].iloc[0]
        return finish(mine)

    buckets = above.withColumnRenamed("index", "bucket")
    return _bucketed(nodes, levels, fanout).groupBy("tree", "bucket").cogroup(buckets.groupBy("tree", "bucket")).applyInPandas(lower, schema)


def _reduced(nodes: DataFrame, levels: int, fanout: int) -> list[DataFrame]:
    """The stages of a reduction, from ``nodes`` to one node for each tree."""
    stages, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        stages.append(_roots(stages[-1], levels, fanout))
        most = -(-most // fanout**levels)
    return stages


def manifest(rows: DataFrame, fanout: int = 2, levels: int = LEVELS, with_proof: bool = False) -> DataFrame:
    """One row per row of ``rows`` (doc_id, tree, hash, claim): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``claim`` is the leaf that is verified, ``hash`` the one that the manifest holds.
    With ``with_proof`` also index, size, rank, trees and proof, which ``fold`` takes.
    """
    ship(rows.sparkSession)
    stages = _reduced(numbered(keep(rows, "leaves"), ["doc_id", "hash"]), levels, fanout)
    tops = _reduced(numbered(stages[-1].select("tree", "hash").withColumn("name", F.col("tree")).withColumn("tree", F.lit("")), ["name"]), levels, fanout)

    names = ["tree", "index", *[c.split()[0] for c in _ABOVE.split(", ")]]
    plain = "tree string, index long, " + _ABOVE
    # The only tree of subroots has one top: the root, whose own proof is empty.
    above = tops[-1].select("tree", "index", F.lit("").alias("proof"), F.lit("").alias("subroot"), F.col("hash").alias("root"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("trees"))
    for stage in reversed(tops[1:-1]):
        above = keep(_proved(stage, above, levels, fanout, lambda p: p[names], plain), "proofs")

    def subroots(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree": p["name"], "index": 0, "proof": p["proof"], "subroot": p["hash"], "root": p["root"], "rank": p["index"], "trees": p["size"]})

    if len(tops) > 1:
        above = keep(_proved(tops[0], above, levels, fanout, subroots, plain), "proofs")
    else:  # one tree: its subroot is the root
        above = tops[0].select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("index"), F.lit("").alias("proof"), F.col("hash").alias("subroot"), F.col("hash").alias("root"), F.col("index").alias("rank"), F.col("size").alias("trees"))
    for stage in reversed(stages[1:-1]):
        above = keep(_proved(stage, above, levels, fanout, lambda p: p[names], plain), "proofs")

    def verify(p: pd.DataFrame) -> pd.DataFrame:
        folded = [fold(c, [(i, n), (r, t)], x, fanout) for c, i, n, r, t, x in zip(p["claim"], p["index"], p["size"], p["rank"], p["trees"], p["proof"], strict=True)]
        out = pd.DataFrame({"doc_id": p["doc_id"], "leaf": p["hash"], "subroot": p["subroot"], "root": p["root"], "proof_sha256": p["proof"].map(h), "folded_root": folded})
        out["verified"] = out["folded_root"] == out["root"]
        if with_proof:
            for c in ("index", "size", "rank", "trees", "proof"):
                out[c] = p[c]
        return out

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", index long, size long, rank long, trees long, proof string" if with_proof else ""
    first = stages[0].withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no whole numbers beside nulls
    if len(stages) == 1:  # every tree has one row, or there are no rows
        out = first.join(above.drop("index"), "tree").groupBy("tree").applyInPandas(verify, schema)
    else:
        out = _proved(first, above, levels, fanout, verify, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def leaves(docs: DataFrame, columns: tuple[str, ...], key: str = "doc_id", tree: str = "lang", tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(doc_id, tree, hash, claim) of ``docs``; ``claim`` is the leaf with the ``tampered`` columns ``where`` it holds."""
    col = lambda c: F.col(f"`{c}`")
    own = leaf(*map(col, columns))
    # A null tree is the empty name, the others begin with a sign: they keep their order, null first.
    rows = docs.select(col(key).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), col(tree)), F.lit("")).alias("tree"), own.alias("hash"), (F.when(where, leaf(*[(tampered or {}).get(c, col(c)) for c in columns])).otherwise(own) if where is not None else own).alias("claim"))
    return rows


def tampered_documents(docs: DataFrame, every: int = 7) -> DataFrame:
    """Leaves of documents by language, with one more character claimed where ``every`` divides crc32 of the id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False))
    return leaves(docs, ("doc_id", "source", "lang", "n_chars", "text"), tampered={"n_chars": F.col("n_chars") + 1}, where=hit)
