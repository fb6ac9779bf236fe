"""Numbers and running totals inside groups of any size, without gathering a group in one task.

Rows are dealt out by ranges of (group, order) and numbered as they are written; one row
for each group and range then says how much lies before it.  So a group with a third of
all rows is numbered by many tasks, and the one window looks at ranges, not at rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.session import keep


def laid_out(rows: DataFrame, group: list[str], order: list[str], name: str = "laid") -> DataFrame:
    """``rows`` in files that follow one another by (group, order), with their place ``__at``; rows that are equal in these stand in any order."""
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    laid = tied.repartitionByRange(*group, *order, "__tie").sortWithinPartitions(*group, *order, "__tie").drop("__tie")
    return keep(laid.withColumn("__at", F.monotonically_increasing_id()), name)


def spans(laid: DataFrame, group: list[str], **sums: Column) -> DataFrame:
    """(group, __part, __first, __rows, __before, and __before_<name> of each of ``sums``): one row for each group and range."""
    part = F.shiftright("__at", 33).alias("__part")
    own = laid.groupBy(*group, part).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"), *[F.sum(c).alias(f"__sum_{k}") for k, c in sums.items()])
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    return own.select(*group, "__part", "__first", "__rows", before("__rows").alias("__before"), *[before(f"__sum_{k}").alias(f"__before_{k}") for k in sums])


def _join(laid: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """Null groups match each other."""
    mine = [F.col(c).alias(f"__g{i}") for i, c in enumerate(group)]
    other = found.select(*mine, F.col("__part").alias("__p"), *[c for c in found.columns if c not in (*group, "__part")])
    on = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]
    return laid.join(other, [F.shiftright("__at", 33) == F.col("__p"), *on]).drop("__p", *[f"__g{i}" for i in range(len(group))])


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "index") -> DataFrame:
    """``rows`` with their number from 0 inside their group."""
    laid = laid_out(rows, group, order)
    out = _join(laid, spans(laid, group), group)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__at") - F.col("__first") + F.col("__before")).alias(name))


def running(rows: DataFrame, group: list[str], order: list[str], **sums: Column) -> DataFrame:
    """``rows`` with the totals of ``sums`` over the rows of their group up to and with them."""
    laid = laid_out(rows, group, order)
    inside = Window.partitionBy("__p", *group).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = laid.withColumn("__p", F.shiftright("__at", 33))
    for k, c in sums.items():
        part = part.withColumn(f"__in_{k}", F.sum(c).over(inside))
    out = _join(part.drop("__p"), spans(laid, group, **sums), group)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[(F.col(f"__in_{k}") + F.col(f"__before_{k}")).alias(k) for k in sums])


def write_ordered(rows: DataFrame, path: str, group: str, order: str, first: Column, other: Column, closing: Column | None = None) -> None:
    """Text files below ``path``, in a folder ``<group>=...`` for each group: its rows by ``order`` (unique in the group), a line each, over as many files as it takes.

    A group's first row is written as ``first``, the others as ``other``, and the last one
    with ``closing`` after it.  The names of a folder's files sort in the order of their rows.
    Rows are dealt out by ranges, so no group is gathered; the ends of the groups are marked
    by their whole key, so none is a hot key either.
    """
    ends = rows.groupBy(group).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    ends = ends.select(group, F.explode(F.array_distinct(F.array("__lo", "__hi"))).alias(order), "__lo", "__hi")
    marked = rows.join(ends, [group, order], "left")
    line = F.when(F.col(order) == F.col("__lo"), first).otherwise(other)
    if closing is not None:
        line = F.when(F.col(order) == F.col("__hi"), F.concat(line, closing)).otherwise(line)
    out = marked.select(group, order, line.alias("value")).repartitionByRange(group, order).sortWithinPartitions(group, order)
    out.select(group, "value").write.mode("overwrite").partitionBy(group).text(path)


def read_lines(spark: SparkSession, path: str, group: str) -> DataFrame:
    """(group, line, value) of what :func:`write_ordered` wrote, lines numbered from 0."""
    lines = spark.read.option("lineSep", "\n").schema(f"value string, {group} string").text(path)
    placed = lines.select(group, "value", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    return numbered(placed, [group], ["__file", "__block", "__row"], "line").select(group, "line", "value")
