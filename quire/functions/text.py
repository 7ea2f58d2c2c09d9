"""Text expressions with the whitespace and case rules of the corpus model."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed_values as fv

# (?U) gives \b, \w, \d and \s their Unicode meaning whatever the JDK default is.
UNICODE = "(?U)"
NON_SPACE = UNICODE + r"[^\s\x1c-\x1f]+"
SPACE_RUN = UNICODE + r"[\s\x1c-\x1f]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(fv.WHITESPACE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def all_matches(c: Column, pattern: str, needs: str | None = None) -> Column:
    """Every whole match of ``pattern``, left to right.

    ``needs`` is a cheap pattern that any text with a match must contain; texts
    without it skip the real one.
    """
    found = F.regexp_extract_all(c, F.lit(UNICODE + pattern), F.lit(0))
    if needs is None:
        return found
    held = c.contains(needs) if re.escape(needs) == needs else c.rlike(needs)
    return F.when(held, found).otherwise(F.array().cast("array<string>"))


def words(c: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.regexp_extract_all(c, F.lit(NON_SPACE), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def literal_count(c: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal string."""
    if not term:
        raise ValueError("empty search term")
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")


def quote(term: str) -> str:
    r"""A regex for the literal ``term`` (``\Q..\E`` with embedded ``\E`` kept)."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def literal_pattern(term: str, match_case: bool = False) -> str:
    """The regex for ``term`` itself; with case ignored it matches in the text as it stands, so offsets hold."""
    return quote(term) if match_case else "(?iu)" + quote(term)


def starts_of(c: Column, term: str, match_case: bool = False) -> Column:
    """0-based offset of each occurrence of ``term``.

    The text between occurrences is folded once from left to right, carrying
    the running offset, so a line costs one pass however many hits it has.
    """
    size = len(term)
    parts = F.split(c, literal_pattern(term, match_case), -1)
    folded = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, part: F.struct(
            (acc["at"] + F.length(part) + F.lit(size)).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + F.length(part))).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    return folded


def upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def literal_list(values) -> Column:
    return F.array(*[F.lit(v) for v in values])
