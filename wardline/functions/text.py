"""Text cleaning, word counting and sentence spans as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.patterns import guard_text, may_match
from wardline.plans.scale import once

# Separator between narrative fields, entities decoded in this order, word limit.
FIELD_SEPARATOR = " [SEP] "
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'))
MIN_WORDS = 10

WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"(?U)[\p{L}\p{N}]\S*+"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.btrim(_column(value), F.lit(WHITESPACE))


def collapse(value: Column | str) -> Column:
    """Runs of whitespace to one blank, then trim."""
    return F.trim(F.regexp_replace(_column(value), r"(?U)\s+", " "))


def non_blank(value: Column | str) -> Column:
    """Present and not the empty string."""
    column = _column(value)
    return column.isNotNull() & (column != "")


def clean_text(value: Column | str) -> Column:
    """Tags to blanks, five entities decoded, whitespace collapsed; null becomes empty."""
    text = F.regexp_replace(F.coalesce(_column(value), F.lit("")), r"<[^>]++>", " ")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return collapse(text)


def compose_text(fields: Sequence[Column | str], sep: str = FIELD_SEPARATOR) -> Column:
    """Cleaned non-empty fields joined in the given order."""
    return F.concat_ws(sep, *[F.nullif(clean_text(field), F.lit("")) for field in fields])


def word_count(value: Column | str) -> Column:
    """Blank-separated tokens holding at least one letter or digit."""
    return F.coalesce(F.regexp_count(_column(value), F.lit(WORD)), F.lit(0)).cast("long")


def is_sparse(value: Column | str, min_words: int = MIN_WORDS) -> Column:
    """Fewer than ``min_words`` words; the match stops at the last word needed."""
    enough = r"(?U)^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]\S*+){%d}" % min_words
    return ~F.coalesce(_column(value), F.lit("")).rlike(enough)


def lookup_key(value: Column | str) -> Column:
    """Lower case, punctuation to blanks, whitespace collapsed."""
    lowered = F.lower(F.coalesce(_column(value), F.lit("")))
    return collapse(F.regexp_replace(lowered, r"[_\-/\\.,;:()\[\]{}&+#%*]+", " "))


def any_of(patterns: Sequence[str]) -> str:
    """One case-insensitive Java pattern for a list of alternatives."""
    return "(?iU)(?:" + "|".join(patterns) + ")"


def matches(value: Column | str, patterns: Sequence[str]) -> Column:
    """True where any pattern is found; null text counts as no match."""
    return F.coalesce(_column(value), F.lit("")).rlike(any_of(patterns))


def contains_any(lowered: Column | str, words: Sequence[str]) -> Column:
    """True where the lower-cased text holds any of the literal words."""
    column = F.coalesce(_column(lowered), F.lit(""))
    result = F.lit(False)
    for word in words:
        result = result | column.contains(word)
    return result


RARE_BLANKS = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def add_lines(df: DataFrame, text: Column | str, name: str = "_lines", low: str = "_guard") -> DataFrame:
    """Adds the text with one sentence per line, and its lower case for literal guards.

    Sentences end at ``. newline ; !``; inside a line every run of whitespace is one blank. Plain
    byte replacements do the work, patterns run only on the texts that need them.
    """
    raw = F.coalesce(_column(text), F.lit(""))
    for mark, plain in ((".", "\n"), (";", "\n"), ("!", "\n"), ("\t", " "), ("\r", " ")):
        raw = F.replace(raw, F.lit(mark), F.lit(plain))
    out = once(df, _raw=raw)
    odd = F.when(F.col("_raw").rlike(RARE_BLANKS), F.regexp_replace("_raw", RARE_BLANKS, " ")).otherwise(F.col("_raw"))
    out = once(out, _odd=odd).drop("_raw")
    tight = F.when(F.col("_odd").contains("  "), F.regexp_replace("_odd", " {2,}", " ")).otherwise(F.col("_odd"))
    out = once(out, **{name: tight}).drop("_odd")
    return once(out, **{low: guard_text(F.col(name))})


def in_lines(patterns: Sequence[str]) -> list[str]:
    """The patterns for one-blank lines: whitespace is a blank and can not reach over a line end."""
    return [re.sub(r"\\s\*", " ?", re.sub(r"\\s\+", " ", p)).replace(r"\s", " ") for p in patterns]


def line_match(lines: Column | str, patterns: Sequence[str], low: Column | str | None = None) -> Column:
    """Some line matches any pattern. ``low`` (see ``add_lines``) rules most texts out by byte search."""
    body = in_lines(patterns)
    hit = _column(lines).rlike("(?imU)(?:" + "|".join(body) + ")")
    guard = None if low is None else may_match(_column(low), body)
    return hit if guard is None else F.when(guard, hit).otherwise(F.lit(False))


def _shorten(span: Column, width: int) -> Column:
    return F.when(F.length(span) > width, F.concat(F.substring(span, 1, width - 3), F.lit("..."))).otherwise(span)


def _whole_line(patterns: Sequence[str]) -> str:
    return r"(?imU)^.*?(?:" + "|".join(in_lines(patterns)) + r").*$"


def first_span(
    lines: Column | str, patterns: Sequence[str], width: int = 140, low: Column | str | None = None
) -> Column:
    """First sentence that matches any pattern, shortened to ``width``; null if none does."""
    span = F.trim(F.regexp_extract(_column(lines), _whole_line(patterns), 0))
    return F.when(line_match(lines, patterns, low), _shorten(span, width))


def spans(
    lines: Column | str, patterns: Sequence[str], n: int = 3, width: int = 120, low: Column | str | None = None
) -> Column:
    """Up to ``n`` different matching sentences in text order."""
    found = F.regexp_extract_all(_column(lines), F.lit(_whole_line(patterns)), 0)
    listed = F.slice(F.array_distinct(F.transform(found, lambda s: _shorten(F.trim(s), width))), 1, n)
    return F.when(line_match(lines, patterns, low), listed).otherwise(F.array().cast("array<string>"))
