"""String functions. Column expressions stay in the JVM; only NFKC needs a pandas UDF."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode white space as str.split() sees it: the White_Space property and the four separators.
SPACE_CLASS = r"[\x{1c}-\x{1f}\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: The white space of ASCII strings besides the space.
ASCII_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"


@lru_cache(maxsize=1)
def _fold_specials() -> dict[str, str]:
    """Characters whose case folding is not their lower case, by rule from the Unicode database, and the capital sigma,
    whose lower case depends on its place."""
    return {"Σ": "σ"} | {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(
        c) <= 0xDFFF and c.casefold() != c.lower()}


@lru_cache(maxsize=1)
def _special_class() -> str:
    points = sorted(map(ord, _fold_specials()))
    spans: list[list[int]] = []
    for p in points:
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans) + "]"


def is_ascii(c: Column) -> Column:
    """As many bytes as characters: tells most strings from those that need Unicode rules, without a regular expression."""
    return F.octet_length(c) == F.char_length(c)


def casefold(c: Column) -> Column:
    """Full Unicode case folding. Strings without a special character (nearly all) take plain ``lower``."""
    # one constant, folded when the query is planned
    table = F.from_json(F.lit(json.dumps(_fold_specials())), "map<string,string>")
    slow = F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(table[ch], F.lower(ch))), "")
    return F.when(is_ascii(c), F.lower(c)).when(c.rlike(_special_class()), slow).otherwise(F.lower(c))


def _ascii_space(c: Column) -> Column:
    """Plain spaces for the white space of an ASCII string, none at its ends."""
    return F.trim(F.translate(c, ASCII_SPACE, " " * len(ASCII_SPACE)))


def collapse_space(c: Column) -> Column:
    plain = _ascii_space(c)
    plain = F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, "  +", " ")).otherwise(plain)
    return F.when(is_ascii(c), plain).otherwise(F.trim(F.regexp_replace(c, SPACE_CLASS + "+", " ")))


def strip_space(c: Column) -> Column:
    """``str.strip``: Unicode white space off both ends."""
    plain = F.btrim(c, F.lit(" " + ASCII_SPACE))
    return F.when(is_ascii(c), plain).otherwise(F.regexp_replace(c, rf"^{SPACE_CLASS}+|{SPACE_CLASS}+$", ""))


def norm_alias(c: Column) -> Column:
    """Trimmed, white space collapsed, case folded. Null stays null."""
    return collapse_space(casefold(c))


def blank_to_null(c: Column) -> Column:
    """Null for a string that is empty after trimming."""
    return F.when(strip_space(c) != "", c)


_NON_ALNUM = re.compile(r"[\W_]+")


def folded(s: str | None) -> str | None:
    """NFKC, case folding, every run of characters that are neither letters nor digits to one space, trimmed."""
    return None if s is None else _NON_ALNUM.sub(" ", unicodedata.normalize("NFKC", s).casefold()).strip()


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(folded, na_action="ignore")


def norm_name(c: Column | str) -> Column:
    """``folded`` as a column: ASCII strings inside the JVM, only the others in Python, over Arrow batches."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.when(is_ascii(c), plain).otherwise(_folded(F.when(~is_ascii(c), c)))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def clean_hash(c: Column) -> Column:
    """A stored hash as compared: trimmed, lower case, without an algorithm prefix."""
    return F.regexp_replace(F.lower(strip_space(c)), "^sha-?256:", "")


def page_id(kind: str, c: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{kind}:"), c), 256), 1, 32)


def safe_filename(c: Column) -> Column:
    """Letters, digits, space, ``-`` and ``_`` stay, others become ``_``; 120 characters; ``untitled`` if nothing is left."""
    kept = F.substring(strip_space(F.regexp_replace(c, r"[^\p{L}\p{N} _-]", "_")), 1, 120)
    return F.coalesce(F.when(kept != "", kept), F.lit("untitled"))


def yaml_scalar(c: Column) -> Column:
    """A double-quoted YAML scalar: backslash, quote and line break escaped."""
    body = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), F.coalesce(body, F.lit("")), F.lit('"'))


def first_non_blank(*cols: Column) -> Column:
    """The first argument that is not blank, trimmed; null if all are."""
    return F.coalesce(*[F.when(strip_space(c) != "", strip_space(c)) for c in cols])


def confidence(c: Column, default: float = 1.0, finite_only: bool = False) -> Column:
    """Clamped to 0..1. What is no number takes the default; ``finite_only`` treats NaN and infinities so, else NaN counts as 1."""
    x = c.try_cast("double")
    if finite_only:
        x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(default))))


def valid_confidence(c: Column) -> Column:
    """True for a number in 0..1; null, text and NaN are false."""
    x = c.try_cast("double")
    return F.coalesce((x >= 0) & (x <= 1) & ~F.isnan(x), F.lit(False))


def parse_wikilink(c: Column) -> Column:
    """``[[target#heading|display]]`` without the brackets, as a struct; target and heading are trimmed, the display
    stays as typed; parts that are absent are null."""
    left = F.split_part(c, F.lit("|"), F.lit(1))
    display = F.when(F.contains(c, F.lit("|")), F.regexp_replace(c, r"(?s)^[^|]*\|", ""))
    target = strip_space(F.split_part(left, F.lit("#"), F.lit(1)))
    heading = F.when(F.contains(left, F.lit("#")), strip_space(F.regexp_replace(left, r"(?s)^[^#]*#", "")))
    return F.struct(target.alias("target"), heading.alias("heading"), display.alias("display"))


def format_wikilink(target: Column, heading: Column, display: Column) -> Column:
    return F.concat(
        F.lit("[["), target,
        F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit("#"), heading)).otherwise(F.lit("")),
        F.when(F.coalesce(display, F.lit("")) != "", F.concat(F.lit("|"), display)).otherwise(F.lit("")),
        F.lit("]]"),
    )
