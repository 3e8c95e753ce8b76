"""Unicode-aware text expressions: strip, tokens, lines, joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it (Java's \s is ASCII only): fixed value.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Line boundaries: fixed value.
NL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def unify_newlines(c: Column) -> Column:
    """CRLF and CR become LF, as text-mode reading does."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def tokens(c: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def normalize(c: Column) -> Column:
    """Words joined by one space."""
    return F.array_join(tokens(c), " ")


def _bare(c: Column) -> Column:
    """strip(), without its pattern where the first and the last character are plain."""
    plain = F.left(c, F.lit(1)).between("!", "~") & F.right(c, F.lit(1)).between("!", "~")
    return F.when(plain, c).otherwise(strip(c))


def lines(c: Column) -> Column:
    """Stripped lines of the stripped text; inner blank lines stay as empty strings; none for blank text."""
    split = lambda whole: F.when(whole == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(whole, NL), _bare))
    return F.element_at(F.transform(F.array(strip(c)), split), 1)  # an array of one: the text is stripped once


def join_lines(parts: Column) -> Column:
    """Recognised lines of a page: nulls skipped, joined by LF, stripped."""
    return strip(F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n"))


def join_pages(parts: Column, separator: str = "\n\n") -> Column:
    """Page texts joined, empty ones dropped, stripped."""
    return strip(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), separator))


def join_outputs(parts: Column) -> Column:
    """Model outputs of a document's pages joined by one LF, empty ones dropped."""
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")


def assistant_reply(raw: Column) -> Column:
    """What follows the last assistant marker of a decoded chat, without a leading role word."""
    after = strip(F.element_at(F.split(strip(raw), "\nassistant\n"), -1))
    return F.when(after.startswith("assistant"), F.regexp_replace(after, rf"^assistant{WS}*", "")).otherwise(after)


#: Signs of a daily quota in a message: fixed values.
DAILY_SIGNS = ("requests_per_day", "per_day", "daily", "GenerateRequestsPerDayPerProjectPerModel")


def quota_exhausted(message: Column) -> Column:
    """Does an error message speak of a daily quota?"""
    low = F.lower(F.coalesce(message, F.lit("")))
    found = F.lit(False)
    for s in DAILY_SIGNS:
        found = found | F.contains(low, F.lit(s.lower()))
    return found


def data_url(content: Column, mime: str = "image/png") -> Column:
    """Binary content as a base64 data URL."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))
