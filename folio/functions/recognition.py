"""Clean-up, classification and geometry of recognised lines, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import SPACE, let, utrim

# The patterns and symbols below define what the block types mean.
SYMBOLS = "{}[]();=<>:+-*/_.`\"'\\"
CHAPTER_SUFFIX = r"\b(\d{1,2})\s*[강잔정]\b"
REST_PATH = r"(?i)\b(GET|POST|PUT|DELETE)\s+users/(\d+)"
HEADING = rf"(?i)^(\d+{SPACE}*장|chapter{SPACE}+\d+|part{SPACE}+\d+)"
CAPTION = r"(?i)^(그림|표|fig\.?|figure|table)\s*"
# Words end where no letter, number or underscore stands; Java's \b leaves out some numbers and lets marks continue a word.  The letter 𝒊 in the look-behind makes Java step by code points there.  The long s is an s in any case, which Java's (?i) leaves out.
CODE_WORD = r"(?i)((?<![\p{L}\p{N}_𝒊])(def|cla[sſ][sſ]|return|import|[sſ]elect|from|where|if|for|while)(?![\p{L}\p{N}_])|[{}\[\];]|=>|==|!=)"
JSON_KEY = rf'^{SPACE}*"[A-Za-z0-9_]+"{SPACE}*:'
VERB_PREFIX = r"(?i)^(GET|PO[Sſ]T|PUT|DELETE) /"
CODE_RATIO = 0.12
SCALES = {"quality": 3.0, "fast": 2.0}
DEFAULT_SCALE = 2.4


def normalize_line(c: Column) -> Column:
    """Trim, repair a misread chapter suffix, and give REST paths their slash."""
    suffix = F.regexp_replace(utrim(c), CHAPTER_SUFFIX, "$1장")
    return F.regexp_replace(suffix, REST_PATH, "$1 /users/$2")


def _ratio(trimmed: Column) -> Column:
    escaped = "".join("\\" + s for s in SYMBOLS)
    return F.when(trimmed == "", 0.0).otherwise((F.char_length(trimmed) - F.char_length(F.regexp_replace(trimmed, f"[{escaped}]", ""))) / F.char_length(trimmed))


def symbol_ratio(c: Column) -> Column:
    return let(utrim(c), _ratio)


def classify_block(c: Column) -> Column:
    def kind(t: Column) -> Column:
        code = t.rlike(CODE_WORD) | t.rlike(JSON_KEY) | t.rlike(VERB_PREFIX) | (_ratio(t) >= CODE_RATIO)
        return F.when(t == "", "paragraph").when(t.rlike(HEADING), "heading").when(t.rlike(CAPTION), "caption").when(code, "code").otherwise("paragraph")

    return F.coalesce(let(utrim(c), kind), F.lit("paragraph"))


def render_scale(profile: Column) -> Column:
    out = F.lit(DEFAULT_SCALE)
    for name, scale in SCALES.items():
        out = F.when(F.lower(profile) == name, scale).otherwise(out)
    return out


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """Unit box with its origin at the bottom left (x, y, w, h) -> pixel box with its origin at the top left."""
    return F.struct((box["x"] * width).alias("x0"), ((1 - box["y"] - box["h"]) * height).alias("y0"), ((box["x"] + box["w"]) * width).alias("x1"), ((1 - box["y"]) * height).alias("y1"))


def point_box(box: Column, image_width: Column, image_height: Column, page_width: Column, page_height: Column) -> Column:
    """Pixel box -> page points with the origin at the bottom left; at least one point wide and high."""
    sx, sy = page_width / F.greatest(F.lit(1), image_width), page_height / F.greatest(F.lit(1), image_height)
    return F.struct(
        (box["x0"] * sx).alias("x"),
        F.greatest(F.lit(0.0), page_height - box["y1"] * sy).alias("y"),
        F.greatest(F.lit(1.0), (box["x1"] - box["x0"]) * sx).alias("w"),
        F.greatest(F.lit(1.0), (box["y1"] - box["y0"]) * sy).alias("h"),
    )


def page_bounds(source_width: Column, source_height: Column, width: Column, height: Column) -> Column:
    """The source page's size, else the image's own, else US letter."""
    pick = lambda a, b, c: F.coalesce(F.when(a > 0, a), F.when(b > 0, b), F.lit(c)).cast("double")
    return F.struct(pick(source_width, width, 612).alias("width"), pick(source_height, height, 792).alias("height"))
