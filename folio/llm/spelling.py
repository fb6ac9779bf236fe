"""Groups of spelling variants: words that are one insertion, deletion or replacement apart, by rolling-hash deletions.

Words (runs of Latin letters, A-Z lower-cased) are counted natively, with a partial
count in every task; texts are read in stretches that end with a run.  Then every word
gives one integer key for each letter left out, and one for the whole word: prefix and
suffix polynomial hashes make all of them in NumPy, letter by letter of a batch, with no
string.  The keys are dealt out by their high bits (the radix), sorted, and scanned:

* equal keys with the same place left out: words that differ by one replacement there;
* equal keys of a whole word and of shortened ones: one insertion or deletion.

Only the members of such runs (word numbers, again no strings) get their words back,
and are grouped by the shortened string itself, so a collision of hashes joins nothing.
A run of replacements has at most one word for each letter, and no pair is listed: every
member gets its number of partners and the most frequent one.

A word's form is its near word with the largest count, if that is at least ``ratio``
times its own; forms are followed to the root by pointer doubling.

Defined cases: null text has no words; a null ``doc_id`` counts as empty in the seeds of
``spoilt``; repeated rows count each; words of any length are taken (a word of n letters
costs n keys of 20 bytes); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm import _bytes as B
from folio.session import keep, ship

#: Letters of a word: ASCII and the two Latin-1 columns, one byte each in Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
#: Characters of a stretch of text, without the rest of its last run.
STRETCH = 1 << 16
#: Buckets of the radix: high bits of a key.
RADIX_BITS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, run) of every occurrence."""
    lower = F.translate(F.col(f"`{text}`"), _UPPER, _LOWER)
    stretches = docs.select(F.col(f"`{key}`").alias("doc_id"), F.explode(F.regexp_extract_all(lower, F.lit(f"(?s).{{1,{STRETCH}}}[{LETTERS}]*"), 0)).alias("stretch"))
    return stretches.select("doc_id", F.explode(F.regexp_extract_all("stretch", F.lit(f"[{LETTERS}]+"), 0)).alias("run"))


def spoilt(doc_id: Column, run: Column, one_in: int) -> Column:
    """The run, in one of ``one_in`` cases with one letter less: which, says a hash of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def words(found: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """(id, word, n) of the values ``word``, counted."""
    counted = found.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    return keep(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def latin(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of letters up to U+00FF as one byte each."""
    wide = np.flatnonzero(buf == 0xC3)
    one = buf.copy()
    one[wide] = buf[wide + 1] + 0x40
    left = np.ones(len(buf), bool)
    left[wide + 1] = False
    at = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(left, out=at[1:])
    return one[left], at[offsets]


def deletion_keys(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, word, first): a key for every word (place -1) and for each letter left out; not ``first`` where leaving out the letter before gives the same."""
    prefix = B.prefix_hash(buf)
    _, inverse = B._powers(len(buf) + 2)
    start, end = offsets[:-1], offsets[1:]
    whole = B.span_hash(prefix, start, end)
    word = np.repeat(np.arange(len(start)), end - start)
    at = np.arange(len(buf))
    s, e = start[word], end[word]
    before, after = (prefix[at] - prefix[s]) * inverse[s], (prefix[e] - prefix[at + 1]) * inverse[s + 1]
    cut = B.mix(before + after + (e - s - 1).astype(np.uint64))
    first = np.ones(len(buf), bool)
    first[1:] = (buf[1:] != buf[:-1]) | (at[1:] == s[1:])
    return np.concatenate([whole, cut]), np.concatenate([np.full(len(start), -1), at - s]), np.concatenate([np.arange(len(start)), word]), np.concatenate([np.ones(len(start), bool), first])


def linked(key: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of replacement runs, and of runs of a whole word and shortened ones, among sorted (key, place)."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    spot = new.copy()
    spot[1:] |= place[1:] != place[:-1]
    run = np.cumsum(spot) - 1
    replaced = (np.bincount(run)[run] > 1) & (place >= 0)
    group = np.cumsum(new) - 1
    has_whole = np.bincount(group, weights=place < 0) > 0
    has_cut = np.bincount(group, weights=place >= 0) > 0
    return replaced, (has_whole & has_cut)[group] & first


def members(words_: DataFrame) -> DataFrame:
    """(replaced, place, id): words that share a key with another one."""
    ship(words_.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in B.chunks(batch, "word", 1 << 19):
                key, place, word, first = deletion_keys(*latin(buf, offsets))
                ids = part.column("id").to_numpy()[word]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(ids), pa.array(first)], ["key", "place", "id", "first"])

    keys = words_.select("id", "word").mapInArrow(make, "key long, place int, id long, first boolean")
    radix = F.shiftrightunsigned("key", 64 - RADIX_BITS)
    ordered = keys.repartition(radix).sortWithinPartitions("key", "place")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> pa.RecordBatch:
            replaced, shortened = linked(*(t.column(c).to_numpy() for c in ("key", "place", "first")))
            a, b = np.flatnonzero(replaced), np.flatnonzero(shortened)
            at = np.concatenate([a, b])
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(at)) < len(a)), pa.array(t.column("place").to_numpy()[at]), pa.array(t.column("id").to_numpy()[at])], ["replaced", "place", "id"])

        held: list[pa.RecordBatch] = []  # ends with a run of one key that may go on
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column(0)
            last = int(np.searchsorted(key.to_numpy(), key[-1].as_py()))
            if held and (last or held[-1].column(0)[-1].as_py() != key[-1].as_py()):
                yield found(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif last:
                yield found(pa.Table.from_batches([batch.slice(0, last)]))
            held.append(batch.slice(last))
        if held:
            yield found(pa.Table.from_batches(held))

    return ordered.mapInArrow(scan, "replaced boolean, place int, id long")


def near(words_: DataFrame) -> DataFrame:
    """(id, n_near, form, form_id, form_n) of every word that has a near one; the form is the most frequent of them (ties: the smallest)."""
    rows = members(words_).join(words_, "id")
    rows = rows.withColumn("cut", F.when(F.col("place") < 0, F.col("word")).otherwise(F.concat(F.substr("word", F.lit(1), "place"), F.substr("word", F.col("place") + 2))))
    rows = rows.withColumn("me", F.struct((-F.col("n")).alias("less"), "word", "id"))
    # At most one word for each letter of the alphabet.
    replaced = rows.where("replaced").groupBy("cut", "place").agg(F.array_sort(F.collect_list("me")).alias("all")).where(F.size("all") > 1)
    replaced = replaced.select(F.posexplode("all").alias("at", "me"), F.get("all", F.lit(0)).alias("top"), F.get("all", F.lit(1)).alias("second"), (F.size("all") - 1).cast("long").alias("partners"))
    replaced = replaced.select("me.id", "partners", F.when(F.col("at") == 0, F.col("second")).otherwise(F.col("top")).alias("best"))
    # At most an alphabet for each place of the shorter word.
    whole = F.max(F.when(F.col("place") < 0, F.col("me"))).alias("whole")
    shorter = rows.where("not replaced").groupBy("cut").agg(whole, F.collect_list(F.when(F.col("place") >= 0, F.col("me"))).alias("longer")).where("whole is not null and size(longer) > 0")
    of_whole = shorter.select("whole.id", F.size("longer").cast("long").alias("partners"), F.array_min("longer").alias("best"))
    of_longer = shorter.select(F.explode("longer").alias("me"), "whole").select("me.id", F.lit(1).cast("long").alias("partners"), F.col("whole").alias("best"))
    every = replaced.unionByName(of_whole).unionByName(of_longer).groupBy("id").agg(F.sum("partners").alias("n_near"), F.min("best").alias("best"))
    return every.select("id", "n_near", F.col("best.word").alias("form"), F.col("best.id").alias("form_id"), (-F.col("best.less")).alias("form_n"))


def roots(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, root): where the forms of ``links`` (id, form_id, form) end; counts grow along a chain, so there are no cycles.  Every round doubles the steps."""
    now = keep(links.select("id", F.col("form_id").alias("to"), F.col("form").alias("root")), "links")
    for _ in range(rounds):
        further = now.select(F.col("id").alias("__id"), F.col("to").alias("__to"), F.col("root").alias("__root"))
        step = now.join(further, F.col("to") == F.col("__id"), "left")
        step = keep(step.select("id", F.coalesce("__to", "to").alias("to"), F.coalesce("__root", "root").alias("root"), F.col("__to").isNotNull().alias("moved")), "links")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now.select("id", "root")
    raise RuntimeError("forms did not end")


def variants(words_: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of ``words_`` (id, word, n; words distinct)."""
    found = keep(near(words_), "near")
    kept = F.col("form_n") >= ratio * F.col("n")
    both = keep(words_.join(found, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(kept, F.col("form")).alias("form"), F.when(kept, F.col("form_id")).alias("form_id"), F.when(kept, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(both.where("form is not null"))
    alone = both.where("form is null").withColumn("root", F.col("word"))
    led = both.where("form is not null").join(ends, "id")
    return alone.unionByName(led.select(*alone.columns)).select("word", "form", "root", "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", one_in: int | None = None, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """The variants among the words of ``docs``; with ``one_in``, runs are ``spoilt`` first."""
    found = runs(docs, text, key)
    found = found.select((F.col("run") if one_in is None else spoilt(F.col("doc_id"), F.col("run"), one_in)).alias("word"))
    return variants(words(found, least_length, least_count), ratio)
