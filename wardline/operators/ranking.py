"""Latest rows, review-queue priorities and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERRIDES = ("THREE_WAY_DISAGREEMENT", "HUMAN_OVERRIDES_MODEL", "HUMAN_OVERRIDES_RULE")


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key as one partial aggregation (the largest order columns win)."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    newest = F.max(F.struct(*order, *rest)).alias("_row")
    out = df.groupBy(*keys).agg(newest).select(*keys, "_row.*")
    return out.select(*df.columns)


def priority_tier(overridden: Column, predicted: Column, strength: Column, unreviewed: Column) -> Column:
    """1 disagreement, 2 weak psif candidate, 3 unreviewed psif, 4 other unreviewed, 5 the rest."""
    return (
        F.when(overridden, 1)
        .when(predicted & (F.lower(strength) == "weak"), 2)
        .when(predicted & unreviewed, 3)
        .when(unreviewed, 4)
        .otherwise(5)
    )


def queue_order(mode: str, id_col: str = "incident_id") -> list[Column]:
    """Sort columns of the five queue modes; ties end at the id."""
    score, day = F.col("score").desc_nulls_last(), F.col("incident_date").desc_nulls_last()
    unreviewed = F.when(F.col("adjudication_status") == "UNREVIEWED", 1).otherwise(2)
    strength = F.lower("evidence_strength")
    weak = F.when(strength == "weak", 1).when(strength == "moderate", 2).otherwise(3)
    state = F.col("agreement_state")
    clash = F.when(state.isin(*OVERRIDES), 1).when(state.isNotNull(), 2).otherwise(3)
    tier = priority_tier(
        state.isin(*OVERRIDES), F.col("predicted"), F.col("evidence_strength"),
        F.col("adjudication_status") == "UNREVIEWED",
    )
    modes = {
        "newest": [day],
        "weak_evidence": [weak.asc(), score, day],
        "disagreement": [clash.asc(), day],
        "unreviewed": [unreviewed.asc(), score, day],
        "priority": [tier.asc(), score, day],
    }
    return [*modes[mode], F.col(id_col).asc()]


def union_by_precedence(frames: Sequence[DataFrame], id_col: str, source: str = "source_rank") -> DataFrame:
    """All rows of the first source, then of each later one the ids not seen before: one shuffle on the
    id for any number of sources.
    """
    parts = [f.withColumn(source, F.lit(i)) for i, f in enumerate(frames)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    rest = [c for c in merged.columns if c not in (id_col, source)]
    best = merged.groupBy(id_col).agg(F.min(F.struct(source, *rest)).alias("_row"))
    return best.select(id_col, "_row.*")


def shared_values(df: DataFrame, group: str, value: str, groups: Sequence[object]) -> DataFrame:
    """Values present in every one of the groups."""
    pairs = df.filter(F.col(group).isin(*groups)).select(group, value).distinct()
    return pairs.groupBy(value).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(groups)).select(value)


def not_selected(pool: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the pool whose key is not chosen yet."""
    return pool.join(chosen.select(*keys), list(keys), "left_anti")
