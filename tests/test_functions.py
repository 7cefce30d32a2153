"""Text, code and guard functions at their boundaries."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardline.functions import codes, patterns, text
from wardline.rules.fields import SEVERITY_ACTUAL, SEVERITY_POTENTIAL


def values(spark, rows, column, schema="s string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_sparse_counts_words_with_a_letter_or_digit(spark):
    nine, ten = " ".join(["word"] * 9), " ".join(["word"] * 10)
    rows = [None, "", "   ", "!!! ... ---", nine, ten, ten + " more", nine + " ---", nine + " é"]
    assert values(spark, rows, text.is_sparse("s")) == [True, True, True, True, True, False, False, True, False]
    assert values(spark, rows, text.word_count("s")) == [0, 0, 0, 0, 9, 10, 11, 9, 10]


def test_clean_and_compose(spark):
    assert values(spark, ["<p>a &amp; b</p>\n\tc&nbsp;d", None, "x < y"], text.clean_text("s")) == ["a & b c d", "", "x < y"]
    df = spark.createDataFrame([("one", None, " "), (" a", "<b>b</b>", "c")], "x string, y string, z string")
    assert [r[0] for r in df.select(text.compose_text(["x", "y", "z"])).collect()] == ["one", "a [SEP] b [SEP] c"]


def test_lookup_key(spark):
    assert values(spark, ["Tank-Farm  (No. 3)", None, "A/B_c"], text.lookup_key("s")) == ["tank farm no 3", "", "a b c"]


def test_first_span_is_the_first_matching_sentence(spark):
    long = "x" * 200 + " valve failed"
    rows = ["All fine. The  valve\tfailed; then rain! Valve failed again", "nothing here", None, long]
    df = text.add_lines(spark.createDataFrame([(r,) for r in rows], "s string"), "s")
    got = [r[0] for r in df.select(text.first_span("_lines", [r"valve\s+failed"], low="_guard")).collect()]
    assert got == ["The valve failed", None, None, long[:137] + "..."]
    both = df.select(text.spans("_lines", [r"valve\s+failed"], 3, low="_guard")).collect()[0][0]
    assert both == ["The valve failed", "Valve failed again"]


def test_a_pattern_does_not_reach_over_a_sentence_end(spark):
    df = text.add_lines(spark.createDataFrame([("no valve. failed pump",)], "s string"), "s")
    assert df.select(text.first_span("_lines", [r"valve\s+failed"])).collect()[0][0] is None


def test_literal_guard_never_rules_out_a_match():
    import re

    rng = random.Random(5)
    pool = [r"\b(?:valve|pump)\s+failed\b", r"without\s+(?:a\s+)?guard", r"not\s+tied[- ]off", r"h2s|oxygen\s+level", r"[a-z]+ing"]
    words = "valve pump failed without a guard not tied-off tied off h2s oxygen level sinking".split()
    for _ in range(300):
        line = " ".join(rng.choice(words) for _ in range(6))
        for p in pool:
            literals = patterns.required_literals(p)
            if literals and re.search(p, line):
                assert any(x in line for x in literals)
    assert patterns.required_literals(r"[a-z]+ing") == frozenset({"ing"})
    assert patterns.required_literals(r"a|bcd") is None


def test_severity_codes(spark):
    # the dictionary is searched in order, so a prefix of an early entry wins
    rows = ["First Aid", "LTI", "death at site", "first", "no", "", None, "weird value that is much longer than thirty"]
    got = values(spark, rows, codes.normalise_code(F.col("s"), SEVERITY_ACTUAL))
    assert got[:4] == ["first_aid", "lost_time", "fatality", "first_aid"]
    assert got[4] == "none" and got[5] is None and got[6] is None
    assert got[7] == "weird value that is much longer than thirty"
    assert values(spark, ["Severe", "med", "life"], codes.normalise_code(F.col("s"), SEVERITY_POTENTIAL)) == [
        "serious", "moderate", "fatality"]


def test_flags_and_dates(spark):
    assert values(spark, ["Yes", " x ", "near miss", "N", "", "maybe", None], codes.parse_flag(F.col("s"))) == [
        True, True, True, False, False, None, None]
    got = values(spark, ["2024-02-03", "02/03/2024", "2024-02-30", "NaN", " ", None], codes.parse_date(F.col("s")))
    assert got == [dt.date(2024, 2, 3), dt.date(2024, 2, 3), None, None, None, None]
    same = [
        "2024-1-5", "2024/01/05", "1/5/2024", "05-01-2024", "5.1.2024", "Jan 5, 2024", "january 5 2024", "5 Jan 2024", "5-Jan-2024",
        "2024-01-05T10:00:00", "2024-01-05T23:59:59.123456Z", "2024-01-05 10:00", "2024-01-05T01:00:00+05:30", "1/5/2024 10:00 PM",
    ]
    assert values(spark, same, codes.parse_date(F.col("s"))) == [dt.date(2024, 1, 5)] * len(same)
    other = ["13/2/2024", "2024-13-01", "Foo 5, 2024", "2024-01-05 25h", "20240105x", "1/5", "31/31/2024"]
    assert values(spark, other, codes.parse_date(F.col("s"))) == [dt.date(2024, 2, 13)] + [None] * 6


@pytest.mark.parametrize("score,band", [(0.0, "low"), (0.2499, "low"), (0.25, "medium"), (0.5, "high"), (0.75, "critical"), (1.0, "critical")])
def test_risk_band_is_half_open(spark, score, band):
    assert values(spark, [score], codes.risk_band(F.col("s")), "s double") == [band]


def test_percent_rounds_half_up_and_guards_zero(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (0, 0), (5, 5)], "a long, b long")
    assert [r[0] for r in df.select(codes.percent(F.col("a"), F.col("b"))).collect()] == [12.5, 33.3, 0.0, 100.0]
    assert df.select(codes.ratio(F.col("a"), F.col("b"), 2)).collect()[0][0] == 0.13
