"""Tolerant conversions of source values to codes, flags, dates and bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.text import strip

# Accepted spellings.
TRUE_WORDS = ("true", "yes", "y", "1", "x", "✓", "near miss", "near-miss")
FALSE_WORDS = ("false", "no", "n", "0", "")
NULL_WORDS = ("", "none", "null", "nan", "nat")
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
RISK_CUTS = ((0.25, "low"), (0.50, "medium"), (0.75, "high"))
RISK_TOP = "critical"


def first_entry(table: Sequence[tuple[str, str]], accepts) -> Column:
    """Value of the first (key, value) entry whose key column is accepted, null if none is."""
    keys = F.split(F.lit("\u0001".join(k for k, _ in table)), "\u0001")
    values = F.split(F.lit("\u0001".join(v for _, v in table)), "\u0001")
    return F.get(F.filter(F.arrays_zip(keys, values), lambda e: accepts(e["0"])), F.lit(0))["1"]


def normalise_code(value: Column, codes: Mapping[str, str], max_len: int | None = None) -> Column:
    """Dictionary lookup, then first dictionary entry sharing a prefix, then the raw value (cut if ``max_len`` is given)."""
    key = F.lower(strip(value))
    table = "\u0001".join(f"{k}\u0002{v}" for k, v in codes.items())
    exact = F.try_element_at(F.str_to_map(F.lit(table), F.lit("\u0001"), F.lit("\u0002")), key)
    prefix = first_entry(list(codes.items()), lambda k: F.startswith(key, k) | F.startswith(k, key))
    raw = value if max_len is None else F.substring(value, 1, max_len)
    return F.when(key != "", F.coalesce(exact, prefix, raw))


def parse_flag(value: Column) -> Column:
    """true / false / null from the accepted spellings."""
    key = F.lower(strip(value))
    return F.when(key.isin(*TRUE_WORDS), F.lit(True)).when(key.isin(*FALSE_WORDS), F.lit(False))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("y-M-d")))


def first_date(text: Column) -> Column:
    """Calendar day of a date as people and programs write it, else null.

    Year first with ``-`` or ``/``; month first with ``/`` (day first where the first number is over 12); day first
    with ``-`` or ``.``; English month names or their first three letters, before or after the day. Each with one
    or two digits for month and day, and with or without a time, fraction and zone. The day is taken as written.
    Every form is only tried on text of its shape, as a failed parse costs far more than the test.
    """
    time = r"(?:[T ]+[0-2]?\d:[0-5]\d(?::[0-5]\d(?:[.,]\d{1,9})?)?(?: ?[AaPp][Mm])?(?: ?(?:[Zz]|UTC|GMT|[+-]\d{2}:?\d{2}))?)?$"

    def tried(pattern: str, build) -> Column:
        return F.when(text.rlike(pattern + time), build(*[F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]))

    def month(name: Column) -> Column:
        full = F.lower(name)
        known = F.array(*[F.lit(m) for m in MONTHS])
        hit = F.filter(known, lambda m: (m == full) | (F.left(m, F.lit(3)) == full) | ((full == "sept") & (m == "september")))
        return F.array_position(known, F.get(hit, F.lit(0)))

    def numbers(first: Column, second: Column, year: Column) -> Column:
        swap = first.cast("int") > 12
        return _day(year, F.when(swap, second).otherwise(first), F.when(swap, first).otherwise(second))

    return F.coalesce(
        tried(r"^(\d{4})-(\d{1,2})-(\d{1,2})", _day),
        tried(r"^(\d{4})/(\d{1,2})/(\d{1,2})", _day),
        tried(r"^(\d{1,2})/(\d{1,2})/(\d{4})", numbers),
        tried(r"^(\d{1,2})[-.](\d{1,2})[-.](\d{4})", lambda d, m, y: _day(y, m, d)),
        tried(r"^([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})", lambda m, d, y: _day(y, month(m), d)),
        tried(r"^(\d{1,2})[ -]([A-Za-z]{3,9})\.?,?[ -](\d{4})", lambda d, m, y: _day(y, month(m), d)),
    )


def parse_date(value: Column) -> Column:
    """The day of ``first_date``; null words and anything else give null."""
    text = strip(value)
    return first_date(F.when(~F.lower(text).isin(*NULL_WORDS), text))


def short_text(value: Column, max_len: int | None = None) -> Column:
    """Trimmed text or null when empty; ``max_len=None`` keeps it whole."""
    text = F.nullif(strip(value), F.lit(""))
    return text if max_len is None else F.substring(text, 1, max_len)


def risk_band(score: Column, cuts: Sequence[tuple[float, str]] = RISK_CUTS, top: str = RISK_TOP) -> Column:
    """Half-open bands: below the first cut, below the second cut, …, else ``top``."""
    band = None
    for cut, name in cuts:
        band = F.when(score < cut, name) if band is None else band.when(score < cut, name)
    return F.when(score.isNotNull(), band.otherwise(top))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``100 * part / whole`` rounded half up in integer arithmetic; 0.0 when ``whole`` is 0."""
    return ratio(part * F.lit(100), whole, digits)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """``part / whole`` of two integers, rounded half up in integer arithmetic; 0.0 for a zero base."""
    scale = 10**digits
    whole = whole.cast("long")
    safe = F.when(whole > 0, whole)
    scaled = F.call_function("div", part.cast("long") * F.lit(2 * scale) + safe, safe * F.lit(2))
    return F.coalesce(scaled.cast("double") / F.lit(float(scale)), F.lit(0.0))


def rounded(value: Column, digits: int = 4) -> Column:
    """Half-up rounding of a double by scaling, the same in every engine."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)
