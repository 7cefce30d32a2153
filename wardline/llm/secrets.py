"""Secrets in texts: fixed patterns, and a battery of randomness tests for encoded tokens. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: kinds in the order that breaks ties, pattern, group whose length counts, least length
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
# what a text must match before its spans are built; it only saves work
GUARDS = {"assign": KINDS[0][1], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "random": r"[A-Za-z0-9+/_-]{20}"}
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
# encoding: pattern, letters of its alphabet, shares of digits, capitals, small letters and others
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 16, (10, 0, 6, 0)),
    ("base32", r"^[A-Z2-7]+$", 32, (6, 26, 0, 0)),
    ("base36", r"^([0-9a-z]+|[0-9A-Z]+)$", 36, (10, 0, 26, 0)),
    ("base62", r"^[0-9A-Za-z]+$", 62, (10, 26, 26, 0)),
    ("base64", r"^[0-9A-Za-z+/_-]+$", 64, (10, 26, 26, 2)),
)
LENGTHS = (32, 64, 128)  # bounds of the length classes
BINS = 240  # p-values are compared on a grid of this many steps over 12 powers of ten
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"


def spans(text: Column, kind: str, pattern: str, rank: int, group: int, least: int) -> Column:
    """Matches as (start, rank, stop, kind, value), in code points; the text between matches gives their places."""
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.zip_with(
        F.zip_with(between, whole, lambda b, m: F.struct(b.alias("b"), m.alias("m"))), value,
        lambda x, v: F.struct(F.length(x["b"]).alias("b"), F.length(x["m"]).alias("m"), v.alias("v")),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["b"]
        one = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), (start + x["m"]).alias("stop"), F.lit(kind).alias("kind"),
            x["v"].alias("value"),
        )
        kept = F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct((start + x["m"]).alias("at"), kept.cast(SPAN).alias("out"))

    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    walked = F.aggregate(F.filter(found, lambda x: x["v"].isNotNull()), start, step, lambda acc: acc["out"])
    return F.when(text.rlike(GUARDS[kind]), walked).otherwise(none)


def _tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution (rational approximation of erfc, error below 1e-6)."""
    x = F.abs(z) / math.sqrt(2)
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.3275911)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = series * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(F.lit(1.0) - half)


def encoding(token: Column) -> Column:
    """Inferred encoding: the smallest alphabet that holds the token; null without a digit, as words have none."""
    found = F.lit(None).cast("string")
    for name, pattern, _, _ in reversed(ENCODINGS):
        found = F.when(token.rlike(pattern), F.lit(name)).otherwise(found)
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return F.when(mixed, found)


def _of(name: Column, values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), name)


def p_value(token: Column, name: Column) -> Column:
    """Bonferroni combination of three tests of "every letter was drawn evenly and independently":
    chi-squared of the letter counts, runs of letter classes, lag-one serial correlation.
    """
    n = F.length(token).cast("double")
    letters = F.split(token, "(?!^)")
    size = _of(name, {e[0]: float(e[2]) for e in ENCODINGS})
    squares = F.aggregate(
        F.array_distinct(letters), F.lit(0.0),
        lambda acc, c: acc + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)),
    )
    df = size - 1
    chi = F.greatest(squares * size / n - n, F.lit(0.0))
    p_chi = _tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - F.lit(2.0) / (9 * df))) / F.sqrt(F.lit(2.0) / (9 * df)))

    same = {e[0]: sum((x / e[2]) ** 2 for x in e[3]) for e in ENCODINGS}
    cube = {e[0]: sum((x / e[2]) ** 3 for x in e[3]) for e in ENCODINGS}
    q, c3 = _of(name, same), _of(name, cube)
    classes = F.translate(
        token, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-", "d" * 10 + "u" * 26 + "l" * 26 + "o" * 4
    )
    changes = F.length(F.regexp_replace(classes, r"(.)\1*", "#")) - 1
    spread = (n - 1) * q * (1 - q) + 2 * (n - 2) * (c3 - q * q)
    p_runs = 2 * _tail(F.abs(changes - (n - 1) * (1 - q)) / F.sqrt(spread))

    codes = F.transform(letters, lambda c: F.ascii(c).cast("double"))
    mean = F.aggregate(codes, F.lit(0.0), lambda acc, v: acc + v) / n
    total = F.aggregate(codes, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    last = F.struct(F.lit(0.0).alias("s"), mean.alias("v"))
    lagged = F.aggregate(
        codes, last,
        lambda acc, v: F.struct((acc["s"] + (acc["v"] - mean) * (v - mean)).alias("s"), v.alias("v")), lambda acc: acc["s"],
    )
    p_serial = F.when(total > 0, 2 * _tail(F.abs(lagged / total) * F.sqrt(n))).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """Spans of secrets in every whole text.

    Base spans come from ``KINDS``. Tokens of 20 or more letters of an encoding are then tested for randomness.
    In each length class the Benjamini-Hochberg procedure dismisses tokens as ordinary, so that at most a share
    ``rate`` of the dismissed is expected to be random; the tokens that stay are spans of the kind ``random``
    unless they overlap a base span. p-values are rounded down onto a grid, so the cut needs counts only.

    Null and empty texts have no spans. Null and repeated ids keep their rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*[spans(text, k, p, i, group, least) for i, (k, p, group, least) in enumerate(KINDS)])
    tokens = F.transform(
        spans(text, "random", TOKEN, len(KINDS), 0, 20),
        lambda t: F.struct(*[t[f].alias(f) for f in ("start", "rank", "stop", "kind", "value")], encoding(t["value"]).alias("encoding")),
    )
    rows = docs.select(F.col(id_col).alias("id"), base.alias("base"), F.filter(tokens, lambda t: t["encoding"].isNotNull()).alias("tokens"))
    rows = rows.withColumn("tokens", F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"]))))

    def tested(t: Column) -> Column:
        p = F.greatest(p_value(t["value"], t["encoding"]), F.lit(1e-12))
        length = F.length(t["value"])
        kind = sum(((length >= b).cast("int") for b in LENGTHS), F.lit(0))
        return F.struct(
            t["start"], t["rank"], t["stop"], t["kind"], F.ceil(-F.log10(p) * (BINS / 12)).cast("int").alias("bin"), kind.alias("size"),
        )

    rows = rows.withColumn("tests", F.transform("tokens", tested)).drop("tokens")
    counts = rows.select(F.explode("tests").alias("t")).groupBy("t.size", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    # at most (len(LENGTHS) + 1) * (BINS + 1) rows from here on, whatever the input
    held = counts.groupBy("size").agg(F.collect_list(F.struct("bin", "n")).alias("bins"))
    total = F.aggregate("bins", F.lit(0).cast("long"), lambda acc, b: acc + b["n"])

    def dismissed(b: Column) -> Column:
        lower = F.aggregate("bins", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["bin"] >= b["bin"], x["n"]).otherwise(0))
        return F.pow(F.lit(10.0), -(b["bin"] - 1) * (12 / BINS)) <= rate * lower / total

    cut = held.select("size", F.array_min(F.transform(F.filter("bins", dismissed), lambda b: b["bin"])).alias("cut"))
    cuts = cut.filter("cut is not null").agg(F.map_from_entries(F.collect_list(F.struct("size", "cut"))).alias("cuts"))
    rows = rows.withColumn("cuts", cuts.scalar())
    added = F.transform(
        F.filter("tests", lambda t: t["bin"] < F.coalesce(F.try_element_at("cuts", t["size"]), F.lit(BINS + 1))),
        lambda t: F.struct(t["start"], t["rank"], t["stop"], t["kind"], F.lit("").alias("value")),
    )
    rows = rows.select("id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", added)).alias("spans"))

    def line(column: str) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def many(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        F.col("id").alias(id_col), *[many(k[0]).alias(f"n_{k[0]}") for k in KINDS],
        F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"),
    )
