"""Corpus audit: schema integrity, templates, lexical leakage, hard negatives, paired and edge tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.codes import percent, ratio
from wardline.functions.text import contains_any, strip
from wardline.plans.scale import first_k, top_k, total

# Fixed values.
NULL_WORDS = ("", "none", "null", "nan")
BOILERPLATE = (
    "the reported activity was", "barrier finding:", "the task context was", "the observation was made at",
    "the interacting condition was", "potential consequence was", "risk: unexpected", "the next step was to",
)
HARD_NEGATIVE_CONTROLS = (
    "controlled", "inspected", "completed without incident", "all normal", "routine", "safely isolated",
    "harness arrested", "ppe prevented", "barrier effective", "pre-job meeting",
)
HARD_NEGATIVE_HAZARDS = (
    "high pressure", "crane", "high voltage", "scaffolding", "confined space", "h2s", "excavation", "drilling", "flange",
)


def null_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(field, nulls, rate): null, empty or a null word, all columns in one pass."""
    columns = list(columns or df.columns)
    empty = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).isin(*NULL_WORDS) for c in columns]
    counts = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count_if(e).alias(f"_{i}") for i, e in enumerate(empty)])
    long = counts.select("_total", F.stack(
        F.lit(len(columns)), *[x for i, c in enumerate(columns) for x in (F.lit(c), F.col(f"_{i}"))]
    ).alias("field", "nulls"))
    return long.select("field", "nulls", ratio(F.col("nulls"), F.col("_total")).alias("rate"))


def schema_audit(df: DataFrame, id_col: str, text: str, label: str) -> DataFrame:
    """One row: rows, repeated ids, empty and repeated narratives, class balance.

    Repeats are rows minus distinct values; narratives are compared by hash, so texts are not shuffled.
    """
    told = strip(F.coalesce(F.col(text), F.lit("")))
    base = df.select(
        F.col(id_col).alias("id"), F.when(told != "", F.sha2(told, 256)).alias("digest"), F.col(label).alias("y")
    )
    ids = base.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    texts = base.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    unique = texts.agg(F.struct(F.count(F.lit(1)).alias("u"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d"))).scalar()
    out = base.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("digest").isNull()).alias("empty_narratives"),
        F.count_if(F.col("y") == 1).alias("positive"), F.count_if(F.col("y") == 0).alias("negative"),
        F.count_if(F.col("y").isNull() | ~F.col("y").isin(0, 1)).alias("other_or_missing"),
    )
    return out.select(
        "*", F.coalesce(total(ids, F.sum(F.col("n") - 1)), F.lit(0)).alias("duplicate_ids"),
        unique["d"].alias("duplicate_narratives"), unique["u"].alias("unique_narratives"),
        ratio(F.col("positive"), F.col("positive") + F.col("negative")).alias("positive_ratio"),
    )


def boilerplate(df: DataFrame, text: str, phrases: Sequence[str] = BOILERPLATE) -> DataFrame:
    """(phrase, n, prevalence): narratives holding each phrase, in percent of all rows."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = df.select(low.alias("_low")).agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(F.col("_low").contains(p)).alias(f"_{i}") for i, p in enumerate(phrases)]
    )
    long = hits.select("_total", F.stack(
        F.lit(len(phrases)), *[x for i, p in enumerate(phrases) for x in (F.lit(p), F.col(f"_{i}"))]
    ).alias("phrase", "n"))
    return long.select("phrase", "n", percent(F.col("n"), F.col("_total"), 2).alias("prevalence"))


def sentence_words(df: DataFrame, text: str) -> DataFrame:
    """One row per sentence (over five characters) with its lower-cased words."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    sentences = df.select(F.explode(F.split(low, "[.!?]")).alias("_s")).select(strip("_s").alias("_s"))
    return sentences.filter(F.length("_s") > 5).select(F.split("_s", r"(?U)\s+").alias("words"))


def template_phrases(
    df: DataFrame, text: str, k: int = 10, min_edge: int = 5, min_gram: int = 10
) -> DataFrame:
    """(kind, phrase, n, rank): most frequent 4-word sentence openings and endings and 3-word runs.

    Phrases are counted where they are found (map-side) before the shuffle.
    """
    w = F.col("words")
    n = F.size(w)
    none = F.array().cast("array<struct<kind:string,a:string,b:string,c:string,d:string>>")
    edge = lambda kind, at: F.struct(F.lit(kind).alias("kind"), *[F.element_at(w, at + i).alias(x) for i, x in enumerate("abcd")])
    edges = F.when(n >= 4, F.array(edge("prefix", 1), edge("suffix", -4))).otherwise(none)
    # words are only laid side by side here: a function called for each run would be interpreted
    runs = F.when(n >= 3, F.arrays_zip(
        F.array_repeat(F.lit("trigram"), n - 2).alias("kind"),
        *[F.slice(w, F.lit(i + 1), n - 2).alias(x) for i, x in enumerate("abc")],
        F.array_repeat(F.lit(None).cast("string"), n - 2).alias("d"),
    ).cast("array<struct<kind:string,a:string,b:string,c:string,d:string>>")).otherwise(none)
    phrases = sentence_words(df, text).select(F.inline(F.concat(edges, runs))).select(
        "kind", F.concat_ws(" ", "a", "b", "c", "d").alias("phrase")
    )
    counts = phrases.groupBy("kind", "phrase").agg(F.count(F.lit(1)).alias("n"))
    enough = counts.filter(F.col("n") > F.when(F.col("kind") == "trigram", min_gram).otherwise(min_edge))
    return top_k(enough, k, [F.col("n").desc(), F.col("phrase").asc()], ["kind"])


def template_severity(df: DataFrame, text: str, phrases: Sequence[str] = BOILERPLATE, min_edge: int = 5) -> DataFrame:
    """One row: HIGH over 20 % of a boilerplate phrase, MODERATE over 5 % or any repeated opening, else LOW."""
    peak = total(boilerplate(df, text, phrases), F.max("prevalence"))
    w = F.col("words")
    openings = sentence_words(df, text).filter(F.size(w) >= 4).groupBy(F.array_join(F.slice(w, 1, 4), " ").alias("phrase")).agg(
        F.count(F.lit(1)).alias("n")
    )
    repeated = openings.agg(F.count_if(F.col("n") > min_edge).alias("repeated_openings"))
    out = repeated.withColumn("peak", F.coalesce(peak, F.lit(0.0)))
    severity = (
        F.when(F.col("peak") > 20, "HIGH").when((F.col("peak") > 5) | (F.col("repeated_openings") > 0), "MODERATE")
        .otherwise("LOW")
    )
    return out.withColumn("severity", severity)


def lexical_leakage(
    df: DataFrame, text: str, label: str, min_count: int = 15, k: int | None = None
) -> DataFrame:
    """Words nearly always in one class: counts, positive rate, odds ratio (at most 9999).

    Counts are documents. A word counts from ``min_count`` documents on when over 95 % or under 5 % of
    them are positive.
    """
    y = F.col(label)
    rows = df.filter(y.isin(0, 1))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b[a-z]{3,}\b"), 0))
    counts = rows.select(y.alias("_y"), F.explode(words).alias("word")).groupBy("word").agg(
        F.count_if(F.col("_y") == 1).alias("positive"), F.count_if(F.col("_y") == 0).alias("negative")
    )
    sizes = rows.agg(F.struct(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"))).scalar()
    p, n = F.col("positive"), F.col("negative")
    both = counts.withColumns({"n": p + n, "_t": sizes})
    kept = both.filter((F.col("n") >= min_count) & ((p * 100 > F.col("n") * 95) | (p * 100 < F.col("n") * 5)))
    one = F.lit(1).cast("long")
    odds = (p / F.greatest(one, n)) / (F.greatest(one, F.col("_t.p") - p) / F.greatest(one, F.col("_t.n") - n))
    out = kept.select(
        "word", "n", "positive", "negative", ratio(p, F.col("n")).alias("positive_rate"),
        (F.floor(F.least(odds, F.lit(9999.0)) * 100 + 0.5) / F.lit(100.0)).alias("odds_ratio"),
    )
    if k is None:
        return out
    return first_k(out, k, [F.abs(F.col("positive_rate") - 0.5).desc(), F.col("n").desc(), F.col("word").asc()])


def hard_negatives(
    df: DataFrame,
    text: str,
    label: str,
    hazards: Sequence[str] = HARD_NEGATIVE_HAZARDS,
    controls: Sequence[str] = HARD_NEGATIVE_CONTROLS,
) -> DataFrame:
    """One row: negatives, negatives with a hazard and a control term, their share, ADEQUATE from 15 % on."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = df.filter(F.col(label) == 0).select(low.alias("_low"))
    hard = contains_any("_low", hazards) & contains_any("_low", controls)
    out = rows.agg(F.count(F.lit(1)).alias("negatives"), F.count_if(hard).alias("hard_negatives"))
    share = ratio(F.col("hard_negatives"), F.col("negatives"))
    return out.select("*", share.alias("share"), F.when(share >= 0.15, "ADEQUATE").otherwise("SPARSE").alias("verdict"))


def paired_test(scored: DataFrame, pair: str, variant: str, score: str, a: str, b: str, margin: float = 0.05) -> DataFrame:
    """Per pair the score difference of variant ``a`` over ``b`` and whether it exceeds the margin."""
    pick = lambda v: F.max(F.when(F.col(variant) == v, F.col(score)))
    both = scored.groupBy(pair).agg(pick(a).alias("score_a"), pick(b).alias("score_b"))
    delta = F.floor((F.col("score_a") - F.col("score_b")) * 10000 + 0.5) / F.lit(10000.0)
    rows = both.filter(F.col("score_a").isNotNull() & F.col("score_b").isNotNull())
    return rows.select(pair, "score_a", "score_b", delta.alias("delta"), (delta > margin).alias("passed"))


def paired_summary(tested: DataFrame) -> DataFrame:
    """One row: pairs, pairs told apart, accuracy and its band."""
    out = tested.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("passed").alias("correct"))
    acc = ratio(F.col("correct"), F.col("pairs"))
    band = F.when(acc >= 0.80, "STRONG").when(acc >= 0.60, "MODERATE").otherwise("POOR")
    return out.select("*", acc.alias("accuracy"), band.alias("validity"))


def edge_pass_rate(scored: DataFrame, score: str, limit: float = 0.5) -> DataFrame:
    """One row: edge cases, those scored under the limit, the rate and a verdict."""
    out = scored.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col(score) < limit).alias("passed"))
    rate = ratio(F.col("passed"), F.col("cases"))
    verdict = F.when(F.col("passed") == F.col("cases"), "ROBUST").when(rate >= 0.8, "MODERATE").otherwise("VULNERABLE")
    return out.select("*", rate.alias("pass_rate"), verdict.alias("verdict"))

