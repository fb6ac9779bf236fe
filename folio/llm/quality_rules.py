"""Quality rules from distribution divergence, in DataFrame operations only.

Every document gets two histograms: code points by character class, and words by
the most common words of its language.  Each is compared with the reference of its
language - the pooled histogram of all documents of that language that pass the base
rules - by Jensen-Shannon distance (square root of the base-2 divergence, 0 to 1).  A
document is rejected if it fails the base rules, or if it is long enough for a
histogram to mean something and the distance exceeds the limit.  A histogram of n words
is off its language by chance alone, by a distance that falls with the square root of
n; so does the limit of the word test.

Passes: one counts words by language (map-side sums first); one computes all
per-document numbers, written once as a table of about a hundred bytes a row; the
references are sums over that table.  Every language has its own reference.  Up to
``BROADCAST_LANGS`` of them are broadcast; beyond that only those with a large share of
the rows are, and the rows of the others are joined by language.

Repeated 3-word windows are found by hash, sorted with their places; the words of every
window so found are compared, and a text with windows of equal hash and different words
is counted over the words themselves.

Defined cases: null or blank text has no words and fails the base rules; rows without a
language are a language of their own; null or repeated ``doc_id`` values are judged row
by row; equal texts of a language get equal verdicts; an empty table gives no rows;
other columns are ignored (or passed through by :func:`keep_good`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm._skew import attach
from folio.llm.exact_dedup import without_ids
from folio.session import keep

#: The rules' limits: smallest document, share of repeated words in per cent.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Words a document must have for the tests; largest distance of characters; of words: WORD_DISTANCE + WORD_NOISE / sqrt(words).
TEST_MIN_WORDS, MAX_CHAR_DISTANCE = 50, 0.32
WORD_DISTANCE, WORD_NOISE = 0.10, 2.2
#: Words in the list of a language; languages whose lists are broadcast; parts in which the counts of a language are ranked first.
COMMON_WORDS, BROADCAST_LANGS, RANK_PARTS = 24, 4096, 32
#: Languages whose words become one set of literals; with more, each text looks through its own list.  Results are the same.
LITERAL_LANGS = 512
_SPACE = r"[\x20\x09-\x0D]"
CLASSES = ("upper", "lower", "digit", "space", "mark", "symbol", "wide")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE + "+"), "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = F.size(words)
    at = lambda i: F.get(words, i.cast("int"))
    none = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.lit(3).cast("long"), p - F.coalesce(F.get(places, j - 1), p - 3)))
        return F.aggregate(steps, none, lambda a, s: a + s)

    def by_hash(span: Column) -> Column:
        """``span`` is a power of two above n: the place of a window takes the low bits of its hash, as many as the text needs."""
        place = lambda x: x.bitwiseAND(span - 1)
        packed = F.transform(F.slice(words, F.lit(1), n - 2), lambda w, i: F.xxhash64(w, at(i + 1), at(i + 2)).bitwiseAND(-span).bitwiseOR(i.cast("long")))
        equal = lambda x, y: x.bitwiseXOR(y).between(0, span - 1)
        differ = lambda x, y: (at(place(x)) != at(place(y))) | (at(place(x) + 1) != at(place(y) + 1)) | (at(place(x) + 2) != at(place(y) + 2))

        def compared(sorted_: Column) -> Column:
            with_next = F.zip_with(F.slice(sorted_, F.lit(1), F.size(sorted_) - 1), F.slice(sorted_, F.lit(2), F.size(sorted_)), equal)

            def places(same: Column) -> Column:
                twice = F.filter(sorted_, lambda x, j: F.coalesce(F.get(same, j - 1), F.lit(False)) | F.coalesce(F.get(same, j), F.lit(False)))
                clash = lambda t: F.filter(t, lambda x, j: F.coalesce(equal(x, F.get(t, j - 1)) & differ(x, F.get(t, j - 1)), F.lit(False)))
                checked = _let(twice, lambda t: F.when(F.size(clash(t)) == 0, _let(F.sort_array(F.transform(t, place)), covered)).otherwise(by_words()))
                return F.when(F.array_contains(same, True), checked).otherwise(none)

            return _let(with_next, places)

        return _let(F.sort_array(packed), compared)

    def by_words() -> Column:
        windows = F.transform(F.slice(words, F.lit(1), n - 2), lambda w, i: F.struct(w.alias("a"), at(i + 1).alias("b"), at(i + 2).alias("c"), i.cast("long").alias("i")))
        equal = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

        def twice(sorted_: Column) -> Column:
            return F.filter(sorted_, lambda x, j: F.coalesce(equal(F.get(sorted_, j - 1), x), F.lit(False)) | F.coalesce(equal(F.get(sorted_, j + 1), x), F.lit(False)))

        return _let(F.sort_array(F.transform(_let(F.sort_array(windows), twice), lambda x: x["i"])), covered)

    span = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n)).cast("int"))
    return F.when(n < 4, none).otherwise(_let(span, by_hash))


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, docs, ref_words): the rows of each language and its most common words."""
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    counted = docs.select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), "word"]
    # Ranked in parts of a language first, so that no task gets the candidates of all tasks.
    parts = counted.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(RANK_PARTS)))
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= COMMON_WORDS).drop("rank")
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= COMMON_WORDS)
    lists = best.groupBy(F.col("lang").alias("__lang")).agg(F.array_sort(F.collect_list("word")).alias("ref_words"))
    none = F.array().cast("array<string>")
    return keep(sizes.join(lists, F.col("lang").eqNullSafe(F.col("__lang")), "left").select("lang", "docs", F.coalesce("ref_words", none).alias("ref_words")), "common")


def _with_language(rows: DataFrame, langs: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``langs``, one row (lang, docs, ...) for every language of ``rows``."""
    if langs.count() <= BROADCAST_LANGS:
        side = langs.drop("docs").withColumnRenamed("lang", "__lang")
        return rows.join(F.broadcast(side), F.col("lang").eqNullSafe(F.col("__lang"))).drop("__lang")
    total = langs.agg(F.sum("docs")).first()[0] or 0
    return attach(rows, langs, ["lang"], "docs", total).drop("docs")


def measures(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Per document: the base counts, and both histograms as arrays."""
    # Words of any list first (a hash set, where the lists are few enough to be literals), then those of the text's own.
    lists = common.select("ref_words").collect() if common.count() <= LITERAL_LANGS else None
    vocabulary = sorted({w for r in lists for w in r["ref_words"]}) if lists is not None else None
    found = F.filter("words", lambda w: F.array_contains(F.col("ref_words"), w) if vocabulary is None else w.isin(vocabulary) if vocabulary else F.lit(False))
    docs = _with_language(docs.withColumn("text", F.coalesce("text", F.lit(""))), common)
    docs = docs.withColumn("words", words_of(F.col("text")))
    count = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    solid = F.length(F.array_join("words", ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.select(
        "doc_id",
        "lang",
        "ref_words",
        F.size("words").cast("long").alias("n_words"),
        solid.cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        count("[A-Z]+").alias("upper"),
        count("[0-9]+").alias("digit"),
        count(r"[!-/:-@\[-`{-~]+").alias("marks"),
        (F.octet_length("text") - F.length("text")).alias("wide"),
        F.length("text").alias("chars"),
        found.alias("found"),
    )
    mark, space = F.col("marks") - F.col("n_symbols"), F.col("chars") - F.col("word_chars")
    lower = F.greatest(F.lit(0).cast("long"), F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("marks") - F.col("wide"))
    histogram = F.array(*[x.cast("double") for x in (F.col("upper"), lower, F.col("digit"), space, mark, F.col("n_symbols"), F.col("wide"))])
    hits = F.transform("ref_words", lambda r: (F.size("found") - F.size(F.array_remove("found", r))).cast("double"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    docs = docs.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), histogram.alias("chars"), hits.alias("hits"))
    other = F.col("n_words") - F.aggregate("hits", F.lit(0.0), lambda a, x: a + x)
    return docs.select("*", F.concat("hits", F.array(other)).alias("words")).drop("hits")


def references(measured: DataFrame) -> DataFrame:
    """(lang, docs, ref_chars, ref_hits): the histograms of good documents pooled by language; empty ones where none is good."""
    sums = [F.sum(F.when(~F.col("base_failed"), F.get(c, F.lit(i)))).alias(f"{c}{i}") for c, n in (("chars", len(CLASSES)), ("words", COMMON_WORDS + 1)) for i in range(n)]
    fold = lambda c, n: F.array(*[F.coalesce(f"{c}{i}", F.lit(0.0)) for i in range(n)])
    return measured.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), *sums).select("lang", "docs", fold("chars", len(CLASSES)).alias("ref_chars"), fold("words", COMMON_WORDS + 1).alias("ref_hits"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms; 0 where one of them is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = lambda sp, sq: F.zip_with(p, q, lambda a, b: _let(F.struct((F.coalesce(a, F.lit(0.0)) / sp).alias("a"), (F.coalesce(b, F.lit(0.0)) / sq).alias("b")), lambda s: part(s["a"], (s["a"] + s["b"]) / 2) + part(s["b"], (s["a"] + s["b"]) / 2)))
    whole = _let(F.struct(total(p).alias("p"), total(q).alias("q")), lambda s: F.when((s["p"] > 0) & (s["q"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms(s["p"], s["q"])) / 2))).otherwise(0.0))
    return F.coalesce(whole, F.lit(0.0))


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """One row per document: the base counts, both distances, base_failed and kept."""
    plain = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    measured = keep(measures(plain, common_words(plain)), "measures")
    joined = _with_language(measured, keep(references(measured), "references"))
    joined = joined.withColumn("char_distance", distance(F.col("chars"), F.col("ref_chars"))).withColumn("word_distance", distance(F.col("words"), F.col("ref_hits")))
    odd = (F.col("char_distance") > MAX_CHAR_DISTANCE) | (F.col("word_distance") > WORD_DISTANCE + WORD_NOISE / F.sqrt(F.col("n_words")))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", (~F.col("base_failed") & ~((F.col("n_words") >= TEST_MIN_WORDS) & odd)).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The documents that are kept, with all their columns.  Rows that repeat an id stay if all of them are good."""
    verdicts = keep(judge(docs, text, key, lang).where("not kept").select(F.col("doc_id").alias("__rejected")).distinct(), "rejected")
    return without_ids(docs, verdicts, key)
