"""Exact deduplication with a two-pass Bloom filter, in DataFrame operations only.

Pass 1 reads every text once and writes (doc_id, sha256 of the normalised text, row
number).  Two hash functions map each fingerprint to slots of a bit array; the slots
that more than one row hits are set in a filter of bitmaps.  To find them, every task
packs the slots of its rows by block of the array, in two bytes each (as a sparse
bitmap would), by stretches of 2**STRETCH_BITS rows, and of equal slots of a stretch only two
go on, so a text in any number of copies stays small; no fingerprint, id or text moves.  Pass 2 probes the filter: a row with
a slot that nobody else hits is unique and passes straight through; only the others
shuffle, to be grouped by their full fingerprint.

The filter has ``bits_per_row`` bits a row, at most ``MAX_BITS`` (64 MB, the bound
of what is broadcast).  Beyond that size it only lets more rows through to the
grouping, so results stay exact.  A large group of copies is summed map-side, and its
rows get their group by broadcast (``_skew.attach``), so it is no hot key.

Defined cases: null text counts as empty, so null and empty texts are copies; the
smallest non-null ``doc_id`` of a group stays; of several rows with that id, or in a
group without any id (keep_id null), the first one read stays; an empty table gives no
rows; other columns pass through and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm._skew import attach
from folio.session import keep

BITS_PER_ROW = 16
MAX_BITS = 1 << 29
_BLOCK = 32768  # bits of one bitmap
#: Rows of a task whose slots are gathered at once, as a power of two.
STRETCH_BITS = 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def fingerprint(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _slots(print_: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(print_, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def _bitmaps(slots: DataFrame) -> DataFrame:
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))


def _filter_bits(rows: int, bits_per_row: int) -> int:
    return min(MAX_BITS, max(_BLOCK, 1 << max(0, rows * bits_per_row - 1).bit_length()))


def repeated_filter(prints: DataFrame, bits_per_row: int = BITS_PER_ROW) -> tuple[DataFrame, int]:
    """Bitmaps of the slots that at least two rows of ``prints`` (print, and row as ``monotonically_increasing_id`` gives it) hit, and the filter's size in bits."""
    bits = _filter_bits(prints.count(), bits_per_row)
    stretch = F.shiftright("row", STRETCH_BITS)  # of one task: its number is in the high bits
    slots = prints.select(stretch.alias("stretch"), F.explode(F.array(*_slots(F.col("print"), bits))).alias("slot"))
    # collect_list packs map-side: an array of two-byte places for each block and stretch.
    place = F.bitmap_bit_position("slot").cast("short")
    part = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket"), "stretch").agg(F.sort_array(F.collect_list(place)).alias("places"))
    two = F.filter("places", lambda x, i: ~F.coalesce(F.get("places", i - 2) == x, F.lit(False)))
    packed = part.select("bucket", two.alias("places")).groupBy("bucket").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    twice = F.filter("places", lambda x, i: F.coalesce(F.get("places", i - 1) == x, F.lit(False)))
    hit = packed.select("bucket", F.explode(F.array_distinct(twice).cast("array<bigint>")).alias("place"))
    return keep(hit.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bitmap")), "bloom"), bits


def member_filter(members: DataFrame, rows: int, bits_per_row: int = BITS_PER_ROW) -> tuple[DataFrame, int]:
    """The same kind of filter over the values ``print`` of a table with about ``rows`` rows."""
    bits = _filter_bits(rows, bits_per_row)
    return keep(_bitmaps(members.select(F.explode(F.array(*_slots(F.col("print"), bits))).alias("slot"))), "bloom"), bits


def with_maybe(rows: DataFrame, maps: DataFrame, bits: int, print_: str = "print", flag: str = "maybe") -> DataFrame:
    """``rows`` with a boolean: whether the row may have a copy."""
    columns = rows.columns
    found: Column = F.lit(True)
    for k, slot in enumerate(_slots(F.col(print_), bits)):
        # At most MAX_BITS / 8 bytes, whatever the number of rows.
        side = F.broadcast(maps.select(F.col("bucket").alias(f"__bucket{k}"), F.col("bitmap").alias(f"__bitmap{k}")))
        rows = rows.withColumn(f"__slot{k}", slot).join(side, F.bitmap_bucket_number(f"__slot{k}") == F.col(f"__bucket{k}"), "left")
        at = F.bitmap_bit_position(F.col(f"__slot{k}"))
        byte = F.conv(F.hex(F.substring(F.col(f"__bitmap{k}"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = found & F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.select(*[F.col(f"`{c}`") for c in columns], found.alias(flag))


def without_ids(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the ids in ``gone`` (one column, distinct): only rows that the filter over ``gone`` lets through shuffle."""
    maps, bits = member_filter(gone.toDF("print"), gone.count())
    flagged = with_maybe(_packed(docs, F.col(f"`{key}`")), maps, bits)
    left = flagged.where("maybe").join(gone.toDF("gone"), F.col("print").eqNullSafe(F.col("gone")), "left_anti")
    return flagged.where("not maybe").unionByName(left).select("doc.*")


def _packed(docs: DataFrame, print_: Column) -> DataFrame:
    """(doc, print): whole rows in one column, so that theirs may have any name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), print_.alias("print"))


def _prints(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, print, row): ``row`` numbers the rows as they are written, and tells equal ones apart."""
    return keep(docs.select(F.col(f"`{key}`").alias("doc_id"), fingerprint(F.col(f"`{text}`")).alias("print"), F.monotonically_increasing_id().alias("row")), "prints")


def _groups(flagged: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    groups = flagged.where("maybe").groupBy("print").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    return keep(groups.select("print", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), "groups")


def duplicate_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    prints = _prints(docs, text, key)
    maps, bits = repeated_filter(prints)
    flagged = with_maybe(prints, maps, bits)
    groups = _groups(flagged)
    hex_ = F.lower(F.hex("print")).alias("text_sha256")
    alone = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hex_)
    shared = attach(flagged.where("maybe"), groups, ["print"], "group_size", groups.agg(F.sum("group_size")).first()[0] or 0)
    return alone.unionByName(shared.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), hex_))


def drop_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns."""
    prints = _prints(docs, text, key)
    maps, bits = repeated_filter(prints)
    groups = _groups(with_maybe(prints, maps, bits)).select(F.col("print").alias("group"), "keep_id")
    flagged = with_maybe(_packed(docs, fingerprint(F.col(f"`{text}`"))), maps, bits).withColumn("id", F.col("doc").getField(key))
    alone = flagged.where("not maybe")
    # Keyed by fingerprint and id: the copies of a large group go to many tasks.
    shared = flagged.where("maybe").join(groups, (F.col("print") == F.col("group")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi").dropDuplicates(["print", "id"])
    return alone.unionByName(shared).select("doc.*")
