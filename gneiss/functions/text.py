"""Column functions over text: folding, cleaning, tokens, spans of lines."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Accented Latin letters (U+00C0 to U+024F, U+1E00 to U+1EFF) and their base letters; the stroked d counts as d."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, BASE = _folding()
MARKS = "".join(map(chr, range(0x300, 0x370)))
#: Byte sequences of UTF-8 text that was read as Latin-1, and what they were: built by misreading each character.
MOJIBAKE = {c.encode().decode("latin-1"): c for c in "àâáãäåæçèêéëìîíïñòôóõöùûúüýÀÂÁÄÇÈÊÉËÎÏÑÔÖÙÛÜ"}


def unaccent(c: Column) -> Column:
    """Letters without their marks; loose combining marks are dropped."""
    return F.translate(c, ACCENTED + MARKS, BASE)  # what has no counterpart is dropped


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r" \s+|[^\S ]\s*", " "))  # a single space need not be replaced


def fold(c: Column) -> Column:
    """The form in which texts are matched: no accents, lower case, single spaces."""
    return collapse(F.lower(unaccent(c)))


def slug(c: Column, joiner: str = "-", default: str = "document") -> Column:
    """Folded text with all else than letters and digits as one joiner; `default` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(unaccent(c)), "[^a-z0-9]+", joiner), f"^{joiner}+|{joiner}+$", "")
    return F.when(s == "", default).otherwise(s)


def clean(c: Column) -> Column:
    """Extracted text: no soft hyphens or hard spaces, no blank-line runs, no space before punctuation."""
    c = F.translate(c, " ­", " ")
    c = F.regexp_replace(c, r" +([,.;:!?])", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def repair_mojibake(c: Column) -> Column:
    for bad, good in MOJIBAKE.items():
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def tokens(c: Column) -> Column:
    """Runs of letters, digits, underscores and dots of the folded text, in order."""
    return F.regexp_extract_all(fold(c), F.lit(r"([a-z0-9_.]+)"), 1)


def token_count(c: Column) -> Column:
    """Words between white space."""
    s = collapse(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


def preview(c: Column, limit: int) -> Column:
    """At most `limit` characters, cut after a whole word if there is one, with three dots."""
    head = F.substring(c, 1, limit)
    words = F.regexp_replace(head, r"\s+\S*\z", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(words, F.lit("...")))


def paragraphs(c: Column) -> Column:
    """Parts between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.;])\s+"), lambda p: F.trim(p)), lambda p: p != "")

