"""Network samples of local-only runs, and process trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.session import keep


def remote_endpoint(line: Column) -> Column:
    """What follows the arrow in a connection line; empty without one."""
    return F.regexp_extract(line, r"->([^ ]+)", 1)


def is_loopback(endpoint: Column) -> Column:
    """Whether the host part (before the last colon, or inside brackets) is this machine."""
    host = F.when(endpoint.rlike(r"^\[[^\]]+\]"), F.regexp_extract(endpoint, r"^\[([^\]]+)\]", 1)).when(endpoint.rlike(r"^.+:"), F.regexp_extract(endpoint, r"^(.+):[^:]*$", 1)).otherwise(endpoint)
    host = F.lower(F.trim(host))
    v4 = F.regexp_replace(host, r"^(::ffff:|(0+:){5}ffff:)", "")
    return host.isin("localhost", "::1") | host.rlike(r"^(0{1,4}:){7}0{0,3}1$") | v4.rlike(r"^127(\.([0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")


def child_pids(line: Column) -> Column:
    """The process number of a line that lists a child; null for any other line."""
    return F.when(F.trim(line).rlike(r"^[0-9]{1,18}$"), F.trim(line).cast("long"))


def leaving(samples: DataFrame) -> DataFrame:
    """The distinct connections that left the machine, a row each: pid and endpoint, and ``input_pdf`` where samples have it."""
    own = [c for c in ("input_pdf",) if c in samples.columns]
    return samples.where((F.col("endpoint") != "") & ~is_loopback(F.col("endpoint"))).select(*own, "pid", "endpoint").distinct()


def violations(samples: DataFrame) -> DataFrame:
    """One row: number of samples, and the distinct ``pid/endpoint`` that left the machine, sorted; ``leaving`` has them as rows."""
    out = F.col("endpoint") != ""
    return samples.agg(F.count(F.lit(1)).alias("samples"), F.array_sort(F.collect_set(F.when(out & ~is_loopback(F.col("endpoint")), F.concat_ws("/", F.col("pid").cast("string"), "endpoint")))).alias("violations"))


def local_only(report: DataFrame) -> DataFrame:
    """Whether the monitor saw nothing and the self-check held."""
    return report.withColumn("monitor_ok", (F.size("violations") == 0) & F.col("selfcheck_ok"))


def _jumped(edges: DataFrame, root: int) -> DataFrame:
    """(pid, to, steps): from each process with one parent up to the next that has none or several, or is the root; each round doubles the steps."""
    parents = edges.groupBy("pid").agg(F.count_distinct("ppid").alias("n"), F.min("ppid").alias("to"))
    now = keep(parents.where((F.col("n") == 1) & (F.col("pid") != root)).select("pid", "to", F.lit(1).cast("long").alias("steps")), "processes")
    size, steps = now.count(), 1
    while steps <= size:  # a longer way goes round a cycle, and never gets to the root
        further = now.select(F.col("pid").alias("__pid"), F.col("to").alias("__to"), F.col("steps").alias("__steps"))
        step = now.join(further, F.col("to") == F.col("__pid"), "left")
        step = keep(step.select("pid", F.coalesce("__to", "to").alias("to"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), F.col("__to").isNotNull().alias("moved")), "processes")
        now, steps = step.drop("moved"), 2 * steps
        if step.where("moved").isEmpty():
            break
    return now


def process_tree(processes: DataFrame, root: int) -> DataFrame:
    """(pid, depth) of a process and all below it (pid, ppid), each with its shortest way; cycles end.

    Ways through processes with one parent are jumped by pointer doubling, so a chain of n
    takes log2(n) rounds; what is left, processes with several parents, goes level by level.
    """
    spark = processes.sparkSession
    edges = keep(processes.select(F.col("pid").cast("long").alias("pid"), F.col("ppid").cast("long").alias("ppid")).where("pid is not null and ppid is not null").distinct(), "edges")
    ways = _jumped(edges, root)
    start = spark.range(int(root), int(root) + 1).select(F.col("id").alias("pid"), F.lit(0).cast("long").alias("depth"))
    # A junction is as deep as the nearest of its parents' junctions allows.
    several = edges.where(F.col("pid") != root).groupBy("pid").agg(F.collect_set("ppid").alias("p")).where(F.size("p") > 1).select("pid", F.explode("p").alias("ppid"))
    up = several.join(ways.select(F.col("pid").alias("ppid"), "to", "steps"), "ppid", "left")
    up = keep(up.select("pid", F.coalesce("to", "ppid").alias("to"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")).groupBy("pid", "to").agg(F.min("steps").alias("steps")), "junctions")
    known = start
    while True:
        found = up.join(known.select(F.col("pid").alias("to"), "depth"), "to").groupBy("pid").agg(F.min(F.col("depth") + F.col("steps")).alias("depth"))
        better = keep(known.withColumnRenamed("depth", "old").join(found, "pid", "full").select("pid", F.least("old", "depth").alias("depth"), (F.col("old").isNull() | (F.col("depth") < F.col("old"))).alias("new")), "junctions")
        known = better.select("pid", "depth")
        if better.where("new").isEmpty():
            break
    rest = ways.join(known.select(F.col("pid").alias("to"), "depth"), "to").select("pid", (F.col("depth") + F.col("steps")).alias("depth"))
    return known.unionByName(rest).groupBy("pid").agg(F.min("depth").cast("int").alias("depth"))
