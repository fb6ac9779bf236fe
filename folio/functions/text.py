"""Text normalisation and token extraction, Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space (as in RE2: no vertical tab), an edge, a number and an address.  Java's ``$`` also stands before a last U+0085, U+2028 or U+2029; ``\z`` does not.
SPACE = r"[ \t\n\f\r]"
_EDGE = r"^[ \t\n\f\r\p{Z}]+|[ \t\n\f\r\p{Z}]+\z"
NUMBER = r"([0-9]+)"
#: Dotted domains, www and http addresses; ASCII look-arounds stand for an ASCII word boundary.
URL = r"(?i)(https?://\S+|www\.\S+|(?<![A-Za-z0-9_])(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/\S*)?(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?:[a-z0-9-]+\.)+[a-z]{2,}(?![A-Za-z0-9_]))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def rounded(c: Column, digits: int) -> Column:
    """The double rounded as C and SQL engines do it: scaled, then half away from zero; Spark's own ``round`` looks at its shortest decimal text instead."""
    scale = 10.0**digits

    def nearest(y: Column) -> Column:
        low = F.floor(F.abs(y)).cast("double")
        return F.when(F.abs(y) < 2.0**52, F.signum(y) * (low + (F.abs(y) - low >= 0.5).cast("double"))).otherwise(y) / scale

    return let(c * scale, nearest)


def fixed(c: Column, digits: int) -> Column:
    """``%.<digits>f`` as C prints it: by the exact value of the double, ties to even; Java's formatter rounds its shortest decimal text half up.  From 4.6e18 / 10**digits on it is Java's."""
    scale = 10.0**digits

    def exact(x: Column) -> Column:
        # Dekker's product: x * scale is ``near + rest`` without any error.
        high = x * 134217729.0 - (x * 134217729.0 - x)
        near = high * scale + (x - high) * scale
        return F.struct(near.alias("near"), ((x - high) * scale - (near - high * scale)).alias("rest"))

    def text(v: Column) -> Column:
        near, rest = v["near"], v["rest"]
        low = F.floor(near)
        part = near - low.cast("double")
        up = F.when(part == 0.5, (rest > 0) | ((rest == 0) & (low % 2 == 1))).otherwise(part > 0.5)
        k = low + up.cast("long") + F.when(near >= 2.0**52, F.rint(rest)).otherwise(0.0).cast("long")
        return F.when(near < 2.0**62, F.regexp_replace(F.format_string(f"%0{digits + 1}d", k), f"(.{{{digits}}})$", ".$1"))

    sign = F.when(c.cast("string").startswith("-"), "-").otherwise("")
    return F.coalesce(F.concat(sign, let(let(F.abs(c), exact), text)), F.format_string(f"%.{digits}f", c))


def utrim(c: Column) -> Column:
    """Trim white space and Unicode separators, not only blanks."""
    return F.regexp_replace(c, _EDGE, "")


def blank(c: Column) -> Column:
    return F.coalesce(utrim(c), F.lit("")) == ""


def line_feeds(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def _right_trimmed(c: Column) -> Column:
    return F.regexp_replace(line_feeds(c), r"(?md)[ \t]+$", "")


def normalize_prose(c: Column) -> Column:
    """Line feeds only, no blanks at line ends, single blanks, trimmed."""
    return utrim(F.regexp_replace(_right_trimmed(c), r"[\t ]+", " "))


def normalize_code(c: Column) -> Column:
    """Line feeds only, no blanks at line ends, no empty lines around."""
    return F.regexp_replace(_right_trimmed(c), r"^\n+|\n+\z", "")


def normalize_code_line(c: Column) -> Column:
    """One code line with single blanks and none around brackets, commas, colons and slashes."""
    one = F.regexp_replace(c, f"{SPACE}+", " ")
    tight = F.regexp_replace(one, SPACE + r"*([{}\[\],:])" + SPACE + "*", "$1")
    return utrim(F.regexp_replace(tight, f"{SPACE}*/{SPACE}*", "/"))


def code_lines(c: Column) -> Column:
    lines = F.filter(F.split(normalize_code(c), "\n"), lambda x: ~blank(x))
    return F.transform(lines, normalize_code_line)


def key_of(prose: Column) -> Column:
    """The search key of normalised prose."""
    return F.regexp_replace(F.lower(prose), r"[^0-9a-z가-힣]+", "")


def search_key(c: Column) -> Column:
    """Lower case, digits, Latin letters and Hangul syllables only."""
    return key_of(normalize_prose(c))


def match_key(c: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", "")


def match_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0B\x0C\u0085\u2028\u2029]"), match_key), lambda x: x != "")


def dump_lines(c: Column) -> Column:
    """Lines of a dump, without empty ones at the end."""
    text = F.regexp_replace(line_feeds(c), r"\n+$", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def number_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NUMBER), 1)


#: Every address has one of these; a plain scan for them spares most texts the full pattern.
URL_SIGN = r"(?i)://|www\.|[a-z0-9-]\.[a-z]{2}"


def url_tokens(c: Column) -> Column:
    return F.when(~c.rlike(URL_SIGN), F.array().cast("array<string>")).otherwise(F.transform(F.regexp_extract_all(c, F.lit(URL), 1), F.lower))


def unique_strings(items: Column) -> Column:
    """Trimmed, non-empty, distinct; the first of equals stays where it is."""
    return F.array_distinct(F.filter(F.transform(items, utrim), lambda x: x != ""))


def union_strings(*arrays: Column) -> Column:
    return unique_strings(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))


def first_filled(*values: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.nullif(utrim(v), F.lit("")) for v in values])


def or_default(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(utrim(c), F.lit("")), F.lit(default))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
