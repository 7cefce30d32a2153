"""Portfolio metrics: one conditional aggregate per report, distinct incidents behind every count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.codes import percent, ratio
from wardline.functions.text import non_blank
from wardline.operators.patterns import top_values
from wardline.plans.scale import count_ids, first_k, top_k, total

# Cuts of the score profile, and the row for incidents without a rule.
PROFILE_CUTS = (0.20, 0.50, 0.75)
NO_RULE_ROW = "No Rule Matched"
HIGH_BANDS = ("high", "critical")


def _linked() -> Column:
    return F.col("predicted") & ~F.col("sparse")


def _prediction_counts(risk: str | None) -> list[Column]:
    sparse, predicted = F.col("sparse"), F.col("predicted")
    high = F.col(risk).isin(*HIGH_BANDS) if risk else F.lit(False)
    return [
        F.count("predicted").alias("predictions"),
        F.count_if(predicted.isNotNull() & sparse).alias("insufficient"),
        F.count_if(predicted.isNotNull() & ~sparse).alias("eligible"),
        F.count_if(predicted & ~sparse).alias("psif"),
        F.count_if(~predicted & ~sparse).alias("not_psif"),
        F.count_if(high & ~sparse).alias("high_risk"),
    ]


def _human_counts(reviewed: Column) -> list[Column]:
    decision, label = F.col("human_decision"), F.col("human_label")
    return [
        F.count_if(reviewed).alias("reviewed"),
        F.count_if((decision == "PSIF") | (decision.isNull() & label)).alias("human_psif"),
        F.count_if((decision == "NOT_PSIF") | (decision.isNull() & ~label)).alias("human_not_psif"),
        F.count_if(decision == "INSUFFICIENT_INFORMATION").alias("human_insufficient"),
    ]


def _with_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "psif_rate": ratio(F.col("psif"), F.col("eligible")),
        "coverage_rate": ratio(F.col("predictions"), F.col("incidents")),
        "reviewed_rate": ratio(F.col("reviewed"), F.col("incidents")),
    })


def summary(df: DataFrame, by: Sequence[str] = (), risk: str | None = "risk_level") -> DataFrame:
    """Incidents, predictions and human decisions with their rates, in one pass.

    ``df`` has one row per incident with ``predicted``, ``sparse``, ``adjudicated``, ``human_decision``,
    ``human_label`` and the risk band.
    """
    reviewed = F.col("adjudicated") | F.col("human_label").isNotNull()
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("incidents"), *_prediction_counts(risk), *_human_counts(reviewed)
    )
    return _with_rates(counts)


def workspace_summary(
    df: DataFrame, reviews: DataFrame, scope: Column, id_col: str = "incident_id", risk: str | None = "risk_level"
) -> DataFrame:
    """As ``summary`` inside a scope; an incident with any review counts as reviewed, once."""
    seen = reviews.select(id_col).distinct().withColumn("_seen", F.lit(True))
    rows = df.filter(scope).join(seen, id_col, "left")
    reviewed = F.col("adjudicated") | F.col("human_label").isNotNull() | F.coalesce("_seen", F.lit(False))
    counts = rows.agg(F.count(F.lit(1)).alias("incidents"), *_prediction_counts(risk), *_human_counts(reviewed))
    return _with_rates(counts)


def score_profile(df: DataFrame, by: Sequence[str] = (), cuts: Sequence[float] = PROFILE_CUTS) -> DataFrame:
    """Score bands of the eligible incidents, average score, reviewed and unreviewed incidents."""
    score, eligible = F.col("score"), F.col("predicted").isNotNull() & ~F.col("sparse")
    low, mid, high = cuts
    return df.groupBy(*by).agg(
        F.count_if(eligible & (score < low)).alias("low"),
        F.count_if(eligible & (score >= low) & (score < mid)).alias("medium"),
        F.count_if(eligible & (score >= mid) & (score < high)).alias("high"),
        F.count_if(eligible & (score >= high)).alias("critical"),
        F.avg(F.when(eligible, score)).alias("average_score"),
        F.count_if("reviewed").alias("reviewed"),
        F.count_if(~F.col("reviewed")).alias("unreviewed"),
    )


def _tagged(tags: DataFrame, df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """One row per (incident, rule) with the incident columns a report needs."""
    return tags.select(id_col, "rule").distinct().join(df.select(id_col, *columns), id_col)


def _with_all_rules(counts: DataFrame, rules: Sequence[str] | None, numbers: Sequence[str]) -> DataFrame:
    """Every listed rule appears, with zeros where nothing matched."""
    if rules is None:
        return counts
    names = counts.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    return names.join(counts, "rule", "left").select(
        "rule", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers]
    )


def _rule_counts(tags: DataFrame, df: DataFrame, id_col: str, site: str) -> DataFrame:
    return _by_site(_tagged(tags, df, id_col, [site, "predicted", "sparse"]), ["rule"], site)


def _by_site(pairs: DataFrame, keys: Sequence[str], site: str) -> DataFrame:
    """Counts per key through counts per (key, site): a hot key is spread over its sites."""
    per_site = pairs.groupBy(*keys, site).agg(
        F.count(F.lit(1)).alias("matched"), F.count_if(_linked()).alias("psif_linked")
    )
    zero = F.lit(0).cast("long")
    return per_site.groupBy(*keys).agg(
        F.coalesce(F.sum("matched"), zero).alias("matched"), F.coalesce(F.sum("psif_linked"), zero).alias("psif_linked"),
        F.count_if(non_blank(site)).alias("affected_sites"),
    )


def _linkage(df: DataFrame) -> DataFrame:
    return df.withColumn("linkage_rate", percent(F.col("psif_linked"), F.col("matched")))


def rule_metrics(
    tags: DataFrame, df: DataFrame, rules: Sequence[str] | None = None, id_col: str = "incident_id", site: str = "site"
) -> DataFrame:
    """Per rule: distinct incidents, psif-linked ones, sites and linkage; plus the row without any rule."""
    numbers = ["matched", "psif_linked", "affected_sites"]
    matched = _with_all_rules(_rule_counts(tags, df, id_col, site), rules, numbers)
    rest = df.join(tags.select(id_col), id_col, "left_anti")
    unmatched = _by_site(rest, [], site).select(F.lit(NO_RULE_ROW).alias("rule"), *numbers)
    return _linkage(matched.unionByName(unmatched))


def barrier_portfolio(
    tags: DataFrame, df: DataFrame, rules: Sequence[str] | None = None, id_col: str = "incident_id", site: str = "site"
) -> DataFrame:
    """Per rule the counts of ``rule_metrics``, and one fleet row of distinct incidents (a union, not a sum)."""
    numbers = ["matched", "psif_linked", "affected_sites"]
    pairs = _tagged(tags, df, id_col, [site, "predicted", "sparse"])
    per_rule = _with_all_rules(_by_site(pairs, ["rule"], site), rules, numbers)
    # the join left the pairs partitioned by incident, so this distinct needs no shuffle of its own
    incidents = pairs.select(id_col, site, "predicted", "sparse").distinct()
    fleet = _by_site(incidents, [], site).select(F.lit("ALL").alias("rule"), *numbers)
    return _linkage(per_rule.unionByName(fleet))


def _rule_items(pairs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(rule, kind, item, n) for several incident columns in one pass."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("item")) for k, c in columns.items()]
    return (
        pairs.select("rule", F.inline(F.array(*kinds)))
        .filter(non_blank("item") & ~((F.col("kind") == "control") & (F.col("item") == "unknown")))
        .groupBy("rule", "kind", "item").agg(F.count(F.lit(1)).alias("n"))
    )


def portfolio_cards(
    tags: DataFrame,
    df: DataFrame,
    id_col: str = "incident_id",
    site: str = "site",
    activity: str = "activity",
    control: str = "control",
    day: str = "event_date",
    samples: int = 4,
) -> DataFrame:
    """Per rule: counts, top activity, top location, dominant control state, newest sample incidents."""
    pairs = _tagged(tags, df, id_col, [site, activity, control, day, "predicted", "sparse"])
    items = _rule_items(pairs, {"activity": activity, "location": site, "control": control})
    best = items.groupBy("rule").agg(*[
        F.min(F.when(F.col("kind") == kind, F.struct((-F.col("n")).alias("n"), "item")))["item"].alias(name)
        for kind, name in (("activity", "top_activity"), ("location", "top_location"), ("control", "dominant_control"))
    ])
    newest = top_k(pairs, samples, [F.col(day).desc_nulls_last(), F.col(id_col).asc()], ["rule"], "_rank")
    ids = newest.groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("_rank", id_col))).alias("_ids"))
    ids = ids.select("rule", F.transform("_ids", lambda x: x[id_col]).alias("samples"))
    counts = _rule_counts(tags, df, id_col, site)
    return _linkage(counts).join(best, "rule", "left").join(ids, "rule", "left")


def barrier_detail(
    tags: DataFrame,
    df: DataFrame,
    rule: str,
    id_col: str = "incident_id",
    k: int = 10,
    page: int = 1,
    columns: Sequence[str] = ("site", "activity", "score", "predicted"),
) -> DataFrame:
    """One page of the incidents of a rule, highest id first, with their position."""
    chosen = df.join(tags.filter(F.col("rule") == rule).select(id_col), id_col, "left_semi")
    top = first_k(chosen.select(id_col, *columns), k * page, [F.col(id_col).desc()])
    return top.filter(F.col("rank") > k * (page - 1))


def breakdown(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows per value, all of them or the ``k`` largest with their rank."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("incidents"))
    return counts if k is None else first_k(counts, k, [F.col("incidents").desc(), F.col(column).asc_nulls_last()])


def batch_status(df: DataFrame, dataset: str, quality: str = "quality_status") -> DataFrame:
    """Per dataset: psif, non-psif, insufficient, and the quality mix."""
    return df.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("incidents"),
        F.count_if(_linked()).alias("psif"),
        F.count_if(~F.col("predicted") & ~F.col("sparse")).alias("non_psif"),
        F.count_if("sparse").alias("insufficient"),
        F.count_if(F.col(quality) == "VALID").alias("accepted"),
        F.count_if(F.col(quality) == "WARNING").alias("warnings"),
        F.count_if(F.col(quality) == "CRITICAL").alias("rejected"),
    )


def throughput(
    runs: DataFrame, kind: str, rows: str, seconds: str, finished: str, run_id: str, last: int = 50, min_rows: int = 1
) -> DataFrame:
    """Rows per second by file type over the newest ``last`` finished runs."""
    usable = runs.filter((F.col(seconds) > 0) & (F.col(rows) >= min_rows))
    newest = top_k(usable, last, [F.col(finished).desc(), F.col(run_id).desc()], [kind], "_rank")
    return newest.groupBy(kind).agg(
        F.count(F.lit(1)).alias("runs"), F.sum(rows).alias("rows"), F.sum(seconds).alias("seconds")
    ).withColumn("rows_per_second", ratio(F.col("rows"), F.col("seconds"), 2))


def list_patterns(
    df: DataFrame, lists: dict[str, str], activity: str | None = None, pair: str | None = None, k: int = 5
) -> DataFrame:
    """(kind, rank, item, n): the ``k`` most frequent elements of several array columns.

    ``pair`` names the list whose elements are also counted together with the activity.
    """
    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("item")))

    parts = [tagged(kind, F.col(column)) for kind, column in lists.items()]
    if activity:
        parts.append(F.array(F.struct(F.lit("activity").alias("kind"), F.col(activity).cast("string").alias("item"))))
        if pair:
            joined = F.transform(lists[pair], lambda v: F.concat(F.col(activity), F.lit(" -> "), v.cast("string")))
            parts.append(tagged("activity_pair", joined))
    items = df.select(F.inline(F.concat(*parts))).filter(non_blank("item"))
    counts = items.groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, k, [F.col("n").desc(), F.col("item").asc()], ["kind"])


def linkage_shares(df: DataFrame, linked: str = "psif_linked", matched: str = "matched") -> DataFrame:
    """Linkage per row, and each row's share of all linked and of all matched incidents."""
    all_linked, all_matched = total(df, F.sum(linked)), total(df, F.sum(matched))
    return df.withColumns({
        "linkage": percent(F.col(linked), F.col(matched), 2),
        "linked_share": percent(F.col(linked), all_linked, 2),
        "matched_share": percent(F.col(matched), all_matched, 2),
    })


def trend(df: DataFrame, day: str) -> DataFrame:
    """Incidents, eligible and psif per month; undated incidents have no month and are left out."""
    months = df.filter(F.col(day).isNotNull()).groupBy(F.date_format(day, "yyyy-MM").alias("month"))
    return months.agg(
        F.count(F.lit(1)).alias("incidents"),
        F.count_if(F.col("predicted").isNotNull() & ~F.col("sparse")).alias("eligible"),
        F.count_if(_linked()).alias("psif"),
    )


def top_items(df: DataFrame, keys: Sequence[str], value: str, k: int, name: str = "top") -> DataFrame:
    """Per group the ``k`` most frequent values as an ordered array of (value, n)."""
    counts = df.filter(non_blank(value)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return top_values(counts, keys, value, "n", k, name)
