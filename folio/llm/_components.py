"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._skew import attach
from folio.session import keep


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); component is the smallest id reached.

    Each round is two grouped minima and joins in one job; its edges are written to the
    shared folder, so no lineage grows.  A node with a large share of all edges gets its
    minimum by broadcast.  The number of rounds is logarithmic in practice;
    ``rounds`` only guards against a run that never ends.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state, total = None, now.count()
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("edges")).select("u", F.least("u", "m").alias("m"), "edges")
        large = attach(both, least, ["u"], "edges", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "__u"), F.col("u") == F.col("__u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state, total = tuple(found), found[0]
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
