"""Cross-site analytics over one long fact table: (incident, site, dimension, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.codes import percent
from wardline.functions.text import non_blank
from wardline.operators.filters import in_window
from wardline.operators.patterns import sample_ids, top_values
from wardline.plans.scale import count_ids, first_k, top_k, total

UNKNOWN = "UNKNOWN"


def site_facts(
    df: DataFrame,
    tags: DataFrame,
    dims: Sequence[str] = ("activity", "hazard", "department"),
    id_col: str = "incident_id",
    day: str = "event_date",
    raw: dict[str, str] | None = None,
) -> DataFrame:
    """(incident_id, site, predicted, day, dimension, value, raw_value) for the dimensions and the rules.

    ``df`` holds one row per incident with canonical values; ``raw`` names the columns with the
    values as reported. Rules come from ``tags`` by one join.
    """
    raw = raw or {}
    base = [
        F.col(id_col).alias("incident_id"), F.coalesce("site", F.lit(UNKNOWN)).alias("site"),
        F.coalesce("predicted", F.lit(False)).alias("predicted"), F.col(day).alias("day"),
    ]
    rows = F.array(*[
        F.struct(
            F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(raw.get(d, d)).alias("raw_value")
        ) for d in dims
    ])
    wide = df.select(*base, F.inline(rows)).filter(non_blank("value"))
    rule_rows = df.select(*base).join(
        tags.select(F.col(id_col).alias("incident_id"), F.col("rule").alias("value")).distinct(), "incident_id"
    )
    rule_rows = rule_rows.select(
        "incident_id", "site", "predicted", "day", F.lit("rule").alias("dimension"), "value",
        F.col("value").alias("raw_value"),
    )
    return wide.unionByName(rule_rows)


def site_overview(df: DataFrame, facts: DataFrame, min_sites: int = 2) -> DataFrame:
    """One row: incidents, known sites, eligible, psif and its rate, active rules, rules on several sites."""
    rules = facts.filter(F.col("dimension") == "rule").select("value", "site").distinct()
    per_rule = rules.groupBy("value").agg(F.count(F.lit(1)).alias("sites"))
    per_site = df.groupBy(F.coalesce("site", F.lit(UNKNOWN)).alias("site")).agg(
        F.count(F.lit(1)).alias("incidents"),
        F.count("predicted").alias("eligible"),
        F.count_if("predicted").alias("psif"),
    )
    out = per_site.agg(
        F.coalesce(F.sum("incidents"), F.lit(0)).alias("incidents"),
        F.count_if(F.col("site") != UNKNOWN).alias("sites"),
        F.coalesce(F.sum("eligible"), F.lit(0)).alias("eligible"),
        F.coalesce(F.sum("psif"), F.lit(0)).alias("psif"),
    )
    return out.select(
        "*", percent(F.col("psif"), F.col("eligible"), 2).alias("psif_rate"),
        total(per_rule, F.count(F.lit(1))).alias("rules"),
        total(per_rule, F.count_if(F.col("sites") >= min_sites)).alias("multi_site_rules"),
    )


def site_comparison(
    df: DataFrame, facts: DataFrame, k: int = 3, kinds: Sequence[str] = ("rule", "activity")
) -> DataFrame:
    """Per site (UNKNOWN included): volumes, psif rate and the top values of each kind."""
    counts = df.groupBy(F.coalesce("site", F.lit(UNKNOWN)).alias("site")).agg(
        F.count(F.lit(1)).alias("incidents"), F.count("predicted").alias("eligible"), F.count_if("predicted").alias("psif")
    )
    items = facts.filter(F.col("dimension").isin(*kinds)).groupBy("site", "dimension", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    lists = top_values(items, ["site", "dimension"], "value", "n", k, "top")
    wide = lists.groupBy("site").agg(
        *[F.max(F.when(F.col("dimension") == kind, F.col("top"))).alias(f"top_{kind}") for kind in kinds]
    )
    return counts.join(wide, "site", "left").select(
        "site", (F.col("site") == UNKNOWN).alias("is_unknown"), "incidents", "eligible", "psif",
        (F.col("eligible") - F.col("psif")).alias("not_psif"),
        percent(F.col("psif"), F.col("eligible")).alias("psif_rate"), *[f"top_{kind}" for kind in kinds],
    )


def site_detail(facts: DataFrame, site: str, k: int = 8, keep_all: Sequence[str] = ("rule",)) -> DataFrame:
    """(dimension, rank, value, n) of one site: the ``k`` most frequent values, all of them for rules."""
    rows = facts.filter(F.col("site") == site)
    counts = rows.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col("value").asc()]
    some = top_k(counts.filter(~F.col("dimension").isin(*keep_all)), k, order, ["dimension"])
    every = counts.filter(F.col("dimension").isin(*keep_all)).withColumn("rank", F.lit(None).cast("long"))
    return some.unionByName(every.select(*some.columns))


def site_recent(df: DataFrame, site: str, day: str, id_col: str = "incident_id", k: int = 10) -> DataFrame:
    """The newest incidents of one site."""
    return first_k(df.filter(F.col("site") == site), k, [F.col(day).desc_nulls_last(), F.col(id_col).asc()])


def cross_site(
    facts: DataFrame, dimension: str, known: Sequence[str] | None = None, aliases: int = 5
) -> DataFrame:
    """Per value: incidents, psif, rate, distinct sites and up to ``aliases`` reported spellings.

    With ``known`` every listed value appears, with zeros when absent.
    """
    rows = facts.filter(F.col("dimension") == dimension)
    per_site = rows.groupBy("value", "site").agg(
        F.count(F.lit(1)).alias("incidents"), F.count_if("predicted").alias("psif")
    )
    counts = per_site.groupBy("value").agg(
        F.sum("incidents").alias("incidents"), F.sum("psif").alias("psif"), F.count(F.lit(1)).alias("sites")
    )
    names = top_k(rows.select("value", "raw_value").distinct(), aliases, [F.col("raw_value").asc()], ["value"], "_rank")
    names = names.groupBy("value").agg(F.sort_array(F.collect_list("raw_value")).alias("aliases"))
    if known is not None:
        listed = facts.sparkSession.createDataFrame([(v,) for v in known], "value string")
        counts = listed.join(counts, "value", "left").fillna(0, ["incidents", "psif", "sites"])
    return counts.join(names, "value", "left").select(
        "value", "incidents", "psif", percent(F.col("psif"), F.col("incidents")).alias("psif_rate"), "sites", "aliases"
    )


def compare_sites(facts: DataFrame, sites: Sequence[str], dims: Sequence[str] = ("rule", "activity")) -> DataFrame:
    """Values every one of the chosen sites has."""
    rows = facts.filter(F.col("site").isin(*sites) & F.col("dimension").isin(*dims))
    pairs = rows.groupBy("dimension", "value", "site").agg(F.count(F.lit(1)).alias("incidents"))
    shared = pairs.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("sites"), F.sum("incidents").alias("incidents")
    )
    return shared.filter(F.col("sites") == len(set(sites))).drop("sites")


def cross_site_recurrence(
    facts: DataFrame, min_sites: int, days: int, as_of: Column, dimension: str = "rule"
) -> DataFrame:
    """Values seen on at least ``min_sites`` sites inside the look-back window."""
    rows = facts.filter((F.col("dimension") == dimension) & in_window("day", None, as_of, days))
    per_site = rows.groupBy("value", "site").agg(F.count(F.lit(1)).alias("incidents"))
    out = per_site.groupBy("value").agg(F.count(F.lit(1)).alias("sites"), F.sum("incidents").alias("incidents"))
    return out.filter(F.col("sites") >= min_sites)


def recurring(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    as_of: Column,
    days: int = 90,
    min_count: int = 3,
    limit: int | None = None,
    id_col: str = "incident_id",
    created: str | None = None,
    samples: int | None = 20,
) -> DataFrame:
    """Key combinations of at least ``min_count`` incidents in the window, with first and last day and
    ``samples`` sample ids; all of them, or the ``limit`` most frequent.
    """
    rows = df.filter(in_window(day, created, as_of, days))
    for key in keys:
        rows = rows.filter(non_blank(key))
    per_id = rows.groupBy(*keys, id_col).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    counts = per_id.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("_first").alias("first_seen"), F.max("_last").alias("last_seen")
    ).filter(F.col("occurrences") >= min_count)
    if limit:
        counts = counts.orderBy(F.col("occurrences").desc(), *[F.col(k).asc() for k in keys]).limit(limit)
    if not samples:
        return counts
    # ids are ranked only for the groups that are kept
    kept = per_id.join(counts.select(*keys), list(keys), "left_semi")
    return counts.join(sample_ids(kept, keys, id_col, samples), list(keys), "left")


def multi_site(
    df: DataFrame,
    key: str,
    site: str,
    day: str,
    as_of: Column,
    days: int = 90,
    min_sites: int = 2,
    values: Sequence[str] | None = None,
    id_col: str = "incident_id",
    created: str | None = None,
) -> DataFrame:
    """Values recurring on several sites: one row per (value, site) so that no site list is gathered.

    Each row has the site's incidents and the value's sites, incidents, first and last day.
    """
    rows = df.filter(in_window(day, created, as_of, days)).filter(non_blank(site))
    if values:
        rows = rows.filter(F.col(key).isin(*values))
    per_id = rows.groupBy(key, site, id_col).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    per_site = per_id.groupBy(key, site).agg(
        F.count(F.lit(1)).alias("site_incidents"), F.min("_first").alias("_first"), F.max("_last").alias("_last")
    )
    totals = per_site.groupBy(key).agg(
        F.count(F.lit(1)).alias("sites"), F.min("_first").alias("first_seen"), F.max("_last").alias("last_seen")
    ).filter(F.col("sites") >= min_sites)
    incidents = count_ids(rows, [key], id_col)
    return per_site.drop("_first", "_last").join(totals, key).join(incidents, key)
