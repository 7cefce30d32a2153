"""Activity, barrier and location patterns over one long observation table.

An observation is (incident_id, dimension, value, day, psif_state, control_state, location, rule).
Counts are of distinct incidents: rows are first reduced to one per (group, incident), then counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.codes import percent, ratio
from wardline.operators.filters import DEFICIENT_STATES
from wardline.plans.scale import count_ids, first_k, ranked, top_k, total

# Fixed values.
EFFECTIVE_STATES = ("EFFECTIVE", "RESTORED_BEFORE_EXPOSURE")
UNKNOWN_ACTIVITY = "UNKNOWN ACTIVITY"
UNKNOWN_LOCATION = "UNKNOWN LOCATION"
NO_RULE = ("None Associated", "Unknown", "none")
HEAT_CUTS = ((75, "critical"), (50, "elevated"), (25, "moderate"))
SAMPLE_IDS = 10

IS_PSIF = "PSIF"


def psif_state(predicted: Column, sparse: Column) -> Column:
    """Sparse reports are insufficient, missing predictions unknown; neither is NOT_PSIF."""
    return (
        F.when(F.coalesce(sparse, F.lit(False)), "INSUFFICIENT_INFORMATION")
        .when(predicted, "PSIF")
        .when(~predicted, "NOT_PSIF")
        .otherwise("UNKNOWN")
    )


def observations(
    df: DataFrame,
    id_col: str = "incident_id",
    activity: str = "activity",
    location: str = "location",
    day: str = "day",
    predicted: str = "predicted",
    sparse: str = "sparse",
    barriers: str | None = None,
) -> DataFrame:
    """One activity row, one location row and one row per barrier of each incident, in one scan.

    ``barriers`` is ``array<struct<name,state,rule>>``.
    """
    null = F.lit(None).cast("string")

    def row(dimension: str, value: Column, state: Column, rule: Column) -> Column:
        return F.struct(
            F.lit(dimension).alias("dimension"), value.alias("value"), state.alias("control_state"), rule.alias("rule")
        )

    fixed_rows = F.array(
        row("activity", F.coalesce(F.col(activity), F.lit(UNKNOWN_ACTIVITY)), null, null),
        row("location", F.coalesce(F.col(location), F.lit(UNKNOWN_LOCATION)), null, null),
    )
    rows = fixed_rows
    if barriers:
        found = F.coalesce(F.col(barriers), F.array().cast("array<struct<name:string,state:string,rule:string>>"))
        rows = F.concat(fixed_rows, F.transform(found, lambda b: row("barrier", b["name"], b["state"], b["rule"])))
    return df.select(
        F.col(id_col).alias("incident_id"),
        F.col(day).alias("day"),
        psif_state(F.col(predicted), F.col(sparse)).alias("psif_state"),
        F.coalesce(F.col(location), F.lit(UNKNOWN_LOCATION)).alias("location"),
        F.inline(rows),
    )


def top_values(
    counts: DataFrame, keys: Sequence[str], value: str, n: str, k: int, name: str
) -> DataFrame:
    """Per group the ``k`` largest values as an ordered ``array<struct<value,n>>`` (ties by value)."""
    best = top_k(counts, k, [F.col(n).desc(), F.col(value).asc()], keys, "_rank")
    packed = F.array_sort(F.collect_list(F.struct("_rank", F.col(value).alias("value"), F.col(n).alias("n"))))
    return best.groupBy(*keys).agg(packed.alias(name)).withColumn(
        name, F.transform(name, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")))
    )


def sample_ids(df: DataFrame, keys: Sequence[str], id_col: str = "incident_id", k: int = SAMPLE_IDS) -> DataFrame:
    """Per group the ``k`` smallest ids, sorted."""
    ids = top_k(df.select(*keys, id_col).distinct(), k, [F.col(id_col).asc()], keys, "_rank")
    return ids.groupBy(*keys).agg(F.sort_array(F.collect_list(id_col)).alias("sample_ids"))


def _flags() -> dict[str, Column]:
    return {
        "psif_linked": F.col("psif_state") == IS_PSIF,
        "effective": F.col("control_state").isin(*EFFECTIVE_STATES),
        "deficient": F.col("control_state").isin(*DEFICIENT_STATES),
    }


def activity_patterns(obs: DataFrame, dimension: str = "activity", min_count: int = 2) -> DataFrame:
    """Incidents, psif-linked incidents, rate, recurring flag and sample ids per value."""
    rows = obs.filter(F.col("dimension") == dimension)
    counts = count_ids(rows, ["value"], "incident_id", {"psif_linked": F.col("psif_state") == IS_PSIF})
    return counts.join(sample_ids(rows, ["value"]), "value", "left").select(
        "value", "incidents", "psif_linked", percent(F.col("psif_linked"), F.col("incidents")).alias("rate"),
        (F.col("incidents") >= min_count).alias("recurring"), "sample_ids",
    )


def state_histogram(obs: DataFrame) -> DataFrame:
    """(value, control_state, observations) of the barrier rows."""
    return obs.filter(F.col("dimension") == "barrier").groupBy("value", "control_state").agg(
        F.count(F.lit(1)).alias("observations")
    )


def barrier_patterns(obs: DataFrame, min_count: int = 2) -> DataFrame:
    """Per barrier: incidents, effective, deficient, psif-linked, locations, dominant state, top rule."""
    rows = obs.filter(F.col("dimension") == "barrier")
    counts = count_ids(rows, ["value"], "incident_id", _flags())
    kinds = rows.select("value", F.inline(F.array(
        F.struct(F.lit("state").alias("kind"), F.col("control_state").alias("item")),
        F.struct(F.lit("rule").alias("kind"), F.when(~F.col("rule").isin(*NO_RULE), F.col("rule")).alias("item")),
        F.struct(
            F.lit("place").alias("kind"),
            F.when(F.col("location") != UNKNOWN_LOCATION, F.col("location")).alias("item"),
        ),
    ))).filter(F.col("item").isNotNull())
    items = kinds.groupBy("value", "kind", "item").agg(F.count(F.lit(1)).alias("n"))
    best = items.groupBy("value").agg(
        F.min(F.when(F.col("kind") == "state", F.struct((-F.col("n")).alias("n"), "item")))["item"].alias("dominant_state"),
        F.min(F.when(F.col("kind") == "rule", F.struct((-F.col("n")).alias("n"), "item")))["item"].alias("top_rule"),
        F.count_if(F.col("kind") == "place").alias("locations"),
    )
    return counts.join(best, "value", "left").select(
        "value", "incidents", "effective", "deficient", "psif_linked",
        percent(F.col("psif_linked"), F.col("incidents")).alias("rate"),
        (F.col("incidents") >= min_count).alias("recurring"),
        F.coalesce("locations", F.lit(0).cast("long")).alias("locations"),
        F.coalesce("dominant_state", F.lit("UNKNOWN")).alias("dominant_state"),
        F.coalesce("top_rule", F.lit("None Associated")).alias("top_rule"),
    )


def heat_level(count: Column, peak: Column) -> Column:
    """critical / elevated / moderate / low by share of the peak rounded to two decimals."""
    share = F.round(ratio(count, peak, 2) * 100).cast("int")
    level = F.when(count == 0, "zero")
    for cut, name in HEAT_CUTS:
        level = level.when(share >= cut, name)
    return level.otherwise("low")


def location_patterns(obs: DataFrame, k: int = 5, min_count: int = 2) -> DataFrame:
    """Per location: counts, intensity against the busiest one, top activities, barriers and rule."""
    counts = count_ids(
        obs.filter(F.col("dimension") == "location"), ["value"], "incident_id",
        {"psif_linked": F.col("psif_state") == IS_PSIF},
    )
    deficient = F.col("control_state").isin(*DEFICIENT_STATES)
    kinds = obs.select(F.col("location").alias("place"), F.inline(F.array(
        F.struct(
            F.when(F.col("dimension") == "activity", "activity")
            .when((F.col("dimension") == "barrier") & deficient, "barrier").alias("kind"),
            F.col("value").alias("item"),
        ),
        F.struct(
            F.when(F.col("dimension") == "barrier", "rule").alias("kind"),
            F.coalesce("rule", "value").alias("item"),
        ),
    ))).filter(F.col("kind").isNotNull() & F.col("item").isNotNull())
    items = kinds.groupBy("place", "kind", "item").agg(F.count(F.lit(1)).alias("n"))
    lists = top_values(items, ["place", "kind"], "item", "n", k, "top")
    wide = lists.groupBy("place").agg(
        *[F.max(F.when(F.col("kind") == kind, F.col("top"))).alias(name)
          for kind, name in (("activity", "top_activities"), ("barrier", "top_barriers"), ("rule", "top_rules"))]
    )
    peak = total(counts, F.max("incidents"))
    return counts.join(wide, F.col("value") == F.col("place"), "left").select(
        "value", "incidents", "psif_linked",
        percent(F.col("psif_linked"), F.col("incidents")).alias("rate"),
        ratio(F.col("incidents"), peak, 2).alias("intensity"),
        heat_level(F.col("incidents"), peak).alias("heat"),
        (F.col("incidents") >= min_count).alias("recurring"),
        "top_activities", "top_barriers",
        F.coalesce(F.get("top_rules", F.lit(0))["value"], F.lit("General Safety Controls")).alias("top_rule"),
        F.concat_ws(
            " > ", "value",
            F.coalesce(F.get("top_activities", F.lit(0))["value"], F.lit("General Site Operations")),
            F.coalesce(F.get("top_barriers", F.lit(0))["value"], F.lit("None Observed")),
        ).alias("chain"),
    )


def recent_observations(obs: DataFrame, k: int = 15) -> DataFrame:
    """Per location the newest incidents with their position."""
    per_incident = obs.groupBy("location", "incident_id").agg(
        F.max("day").alias("day"), F.max(F.when(F.col("dimension") == "activity", F.col("value"))).alias("activity"),
        F.max(F.col("psif_state") == IS_PSIF).alias("is_psif"),
    )
    return top_k(per_incident, k, [F.col("day").desc_nulls_last(), F.col("incident_id").asc()], ["location"])


def temporal_patterns(obs: DataFrame) -> DataFrame:
    """Incidents and psif-linked incidents per month, undated ones apart."""
    months = obs.filter(F.col("dimension") == "activity").withColumn(
        "period", F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("Undated"))
    )
    return count_ids(months, ["period"], "incident_id", {"psif_linked": F.col("psif_state") == IS_PSIF})


def pattern_summary(obs: DataFrame, min_count: int = 2) -> DataFrame:
    """Per dimension: values and recurring values."""
    counts = count_ids(obs, ["dimension", "value"], "incident_id")
    return counts.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("values"), F.count_if(F.col("incidents") >= min_count).alias("recurring")
    )


def rank_share(
    obs: DataFrame, dimension: str = "location", unknown: Sequence[str] = (UNKNOWN_LOCATION,)
) -> DataFrame:
    """Values ranked by incidents with their share of all incidents and the attribution coverage."""
    rows = obs.filter(F.col("dimension") == dimension)
    counts = count_ids(rows, ["value"], "incident_id", {"psif_linked": F.col("psif_state") == IS_PSIF})
    everything = total(obs.select("incident_id").distinct(), F.count(F.lit(1)))
    known = total(rows.filter(~F.col("value").isin(*unknown)).select("incident_id").distinct(), F.count(F.lit(1)))
    out = ranked(counts, [F.col("incidents").desc(), F.col("value").asc()])
    return out.select(
        "rank", "value", "incidents", "psif_linked",
        percent(F.col("incidents"), everything).alias("share"),
        percent(known, everything).alias("coverage"),
    )


def crosstab(
    df: DataFrame, row: str, col: str, id_col: str = "incident_id", flag: Column | None = None, intensity: bool = False
) -> DataFrame:
    """Long cross-tab with totals: level is cell, row, column or all; totals add up their cells.

    With ``intensity`` cells carry 1-4 by their share of the largest cell (<25, <50, <75 %).
    """
    flag = F.lit(False) if flag is None else flag
    cells = count_ids(df, [row, col], id_col, {"psif_linked": flag})
    level = F.element_at(
        F.array(F.lit("cell"), F.lit("row"), F.lit("column"), F.lit("all")), (F.grouping_id() + 1).cast("int")
    )
    out = cells.cube(row, col).agg(
        level.alias("level"), F.sum("incidents").alias("incidents"), F.sum("psif_linked").alias("psif_linked")
    )
    if not intensity:
        return out
    peak, n = total(cells, F.max("incidents")), F.col("incidents")
    step = F.when(n == 0, 0).when(n * 4 < peak, 1).when(n * 2 < peak, 2).when(n * 4 < peak * 3, 3).otherwise(4)
    return out.withColumn("intensity", F.when(F.col("level") == "cell", step))


def crosstab_wide(
    df: DataFrame, row: str, col: str, values: Sequence[str], id_col: str = "incident_id"
) -> DataFrame:
    """One column per listed value (0 when absent) and the row total over those columns."""
    counts = df.groupBy(row, id_col).pivot(col, list(values)).agg(F.lit(1))
    wide = counts.groupBy(row).agg(*[F.count(F.col(f"`{v}`")).alias(v) for v in values])
    row_total = F.lit(0).cast("long")
    for v in values:
        row_total = row_total + F.col(f"`{v}`")
    return wide.withColumn("total", row_total)


def top_column_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of a column (ties by value)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return first_k(counts, k, [F.col("n").desc(), F.col(col).asc()]).select(col)


def _companions(obs: DataFrame, dimension: str) -> DataFrame:
    """(value, kind, item, incidents): what goes with each value of a dimension on the same incident."""
    base = obs.filter(F.col("dimension") == dimension).select("incident_id", "value").distinct()
    others = obs.select(
        "incident_id", F.inline(F.array(
            F.struct(F.col("dimension").alias("kind"), F.col("value").alias("item")),
            F.struct(F.when(F.col("dimension") == "barrier", "rule").alias("kind"), F.col("rule").alias("item")),
        ))
    ).filter(F.col("kind").isNotNull() & F.col("item").isNotNull() & (F.col("kind") != dimension)).distinct()
    return base.join(others, "incident_id").groupBy("value", "kind", "item").agg(F.count(F.lit(1)).alias("n"))


def activity_view(obs: DataFrame, k: int = 4, min_count: int = 2, dimension: str = "activity") -> DataFrame:
    """Ranked activities with share, rate and the top locations, barriers and rules of each."""
    rows = obs.filter(F.col("dimension") == dimension)
    counts = count_ids(rows, ["value"], "incident_id", {"psif_linked": F.col("psif_state") == IS_PSIF})
    lists = top_values(_companions(obs, dimension), ["value", "kind"], "item", "n", k, "top")
    wide = lists.groupBy("value").agg(
        *[F.max(F.when(F.col("kind") == kind, F.col("top"))).alias(name)
          for kind, name in (("location", "top_locations"), ("barrier", "top_barriers"), ("rule", "top_rules"))]
    )
    everything = total(rows.select("incident_id").distinct(), F.count(F.lit(1)))
    out = ranked(counts, [F.col("incidents").desc(), F.col("value").asc()])
    return out.join(wide, "value", "left").select(
        "rank", "value", "incidents", "psif_linked",
        percent(F.col("incidents"), everything).alias("share"),
        percent(F.col("psif_linked"), F.col("incidents")).alias("rate"),
        (F.col("incidents") >= min_count).alias("recurring"),
        "top_locations", "top_barriers", "top_rules",
    )


def barrier_view(obs: DataFrame) -> DataFrame:
    """Ranked barriers with their share of all incidents."""
    counts = count_ids(obs.filter(F.col("dimension") == "barrier"), ["value"], "incident_id", _flags())
    everything = total(obs.select("incident_id").distinct(), F.count(F.lit(1)))
    out = ranked(counts, [F.col("incidents").desc(), F.col("deficient").desc(), F.col("value").asc()])
    return out.select(
        "rank", "value", "incidents", "effective", "deficient", "psif_linked",
        percent(F.col("incidents"), everything).alias("share"),
        percent(F.col("psif_linked"), F.col("incidents")).alias("rate"),
    )


def barrier_callouts(obs: DataFrame) -> DataFrame:
    """The most frequent, most often effective and most often deficient barrier (none for a zero count)."""
    counts = count_ids(obs.filter(F.col("dimension") == "barrier"), ["value"], "incident_id", _flags())
    measures = {"frequent": "incidents", "effective": "effective", "deficient": "deficient"}
    long = counts.select("value", F.inline(F.array(*[
        F.struct(F.lit(name).alias("callout"), F.col(column).alias("n")) for name, column in measures.items()
    ]))).filter(F.col("n") > 0)
    best = long.groupBy("callout").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best"))
    return best.select("callout", F.col("best.value").alias("value"), (-F.col("best.n")).alias("n"))


def pathways(obs: DataFrame) -> DataFrame:
    """(activity, location, barrier, outcome, incidents): known activity and location of an incident
    with each of its deficient barriers, or with a dash where it has none.
    """
    unknown = (UNKNOWN_ACTIVITY, UNKNOWN_LOCATION)
    acts = obs.filter((F.col("dimension") == "activity") & ~F.col("value").isin(*unknown)).select(
        "incident_id", F.col("value").alias("activity"), "psif_state").distinct()
    places = obs.filter((F.col("dimension") == "location") & ~F.col("value").isin(*unknown)).select(
        "incident_id", F.col("value").alias("place")).distinct()
    barriers = obs.filter((F.col("dimension") == "barrier") & F.col("control_state").isin(*DEFICIENT_STATES)).select(
        "incident_id", F.col("value").alias("barrier")).distinct()
    joined = acts.join(places, "incident_id").join(barriers, "incident_id", "left")
    return joined.groupBy(
        "activity", F.col("place").alias("location"), F.coalesce("barrier", F.lit("—")).alias("barrier"),
        F.when(F.col("psif_state") == IS_PSIF, "PSIF Candidate").otherwise("Non-PSIF").alias("outcome"),
    ).agg(F.count(F.lit(1)).alias("incidents"))


def top_pathways(obs: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most frequent pathways with their share of all incidents."""
    everything = total(obs.select("incident_id").distinct(), F.count(F.lit(1)))
    order = [F.col("incidents").desc(), *[F.col(c).asc() for c in ("activity", "location", "barrier", "outcome")]]
    return first_k(pathways(obs), k, order).withColumn("share", percent(F.col("incidents"), everything))
