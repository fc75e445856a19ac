"""Whitespace, slugs and excerpts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters that belong to a tag, and excerpt length.
NOT_TAG_CHARS = "[^A-Za-z0-9_.-]+"
TAG_CHARS_ONLY = "^[A-Za-z0-9_.-]+$"
EXCERPT_CHARS = 700
MIN_TOKEN_CHARS = 3


# The characters that count as white space.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse_ws(text: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_lines(text: Column) -> Column:
    """Strip each line and keep at most one blank line in a row; none at the ends."""
    lines = F.transform(F.split(text, r"\R|[\x1c-\x1e]"), strip)
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(joined, r"^\n+|\n+$", "")


def tokens(text: Column) -> Column:
    """Lowercased tag-like words of at least three characters; repeats are kept."""
    words = F.filter(F.split(text, NOT_TAG_CHARS), lambda w: F.length(w) >= MIN_TOKEN_CHARS)
    return F.transform(words, F.lower)


def slug(text: Column, default: str = "sheet") -> Column:
    """Runs of other characters become ``_``; none at the ends; ``default`` if nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), F.lit("_")), F.lit("")),
                      F.lit(default))


def query_slug(text: Column, default: str = "query", chars: int = 80) -> Column:
    """Runs of other characters of a question become ``_``; none at the ends; cut to ``chars``."""
    return _cut_slug(F.regexp_replace(F.lower(text), "[^a-zA-Z0-9_-]+", "_"), default, chars)


def char_slug(text: Column, default: str = "query", chars: int = 80) -> Column:
    """As ``query_slug``, but each other character becomes one ``_`` and letters of any script stay."""
    return _cut_slug(F.regexp_replace(F.lower(text), r"(?U)[^\p{Alnum}_-]", "_"), default, chars)


def _cut_slug(clean: Column, default: str, chars: int) -> Column:
    return F.coalesce(F.nullif(F.left(F.btrim(clean, F.lit("_")), F.lit(chars)), F.lit("")), F.lit(default))


def excerpt(text: Column, chars: int = EXCERPT_CHARS) -> Column:
    """Collapsed text, cut after ``chars`` characters back to the last space, with an ellipsis."""
    flat = collapse_ws(text)
    cut = F.regexp_replace(F.left(flat, F.lit(chars)), " [^ ]*$", "")
    return F.when(F.length(flat) > chars, F.concat(cut, F.lit("..."))).otherwise(flat)


def contains_any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found
