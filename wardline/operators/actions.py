"""Matching corrective-action templates to reports and merging them by intent."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.rules.actions import INTENTS, TYPE_ORDER, URGENCY_ORDER


@dataclass(frozen=True)
class ActionTemplate:
    action_id: str
    title: str
    action_type: str
    urgency: str
    hazards: Sequence[str]
    controls: Sequence[str]
    states: Sequence[str]
    rule: str | None = None
    when: str | None = None  # "psif", "effective" or "compromised": added by condition, not by matching


def _position(value: str, order: Sequence[str]) -> int:
    return order.index(value) if value in order else 9


def match_actions(
    df: DataFrame,
    id_col: str,
    templates: Sequence[ActionTemplate],
    energy: Column,
    control: Column,
    condition: Column,
    rules: Column,
    psif: Column,
) -> DataFrame:
    """(id, position, action_id, action_type, urgency, title) in order of type, then urgency.

    The templates are a rule table, so each report is matched where it lies.
    """
    energy, control = F.coalesce(energy, F.lit("unknown")), F.coalesce(control, F.lit("unknown"))
    condition = F.coalesce(condition, F.lit("unknown"))
    conditions = {
        "psif": F.coalesce(psif, F.lit(False)), "effective": condition == "effective",
        "compromised": condition.isin("absent", "failed", "bypassed", "unknown"),
    }
    ordered = sorted(templates, key=lambda t: (_position(t.action_type, TYPE_ORDER), _position(t.urgency, URGENCY_ORDER)))
    rows = []
    for t in ordered:
        if t.when:
            fits = conditions[t.when]
        else:
            fits = condition.isin(*t.states)
            if "any" not in t.hazards:
                fits = fits & energy.isin(*t.hazards)
            if "any" not in t.controls:
                fits = fits & control.isin("unknown", *t.controls)
            if t.rule:
                fits = fits & F.array_contains(rules, t.rule)
        rows.append(F.when(fits, F.struct(
            F.lit(t.action_id).alias("action_id"), F.lit(t.action_type).alias("action_type"),
            F.lit(t.urgency).alias("urgency"), F.lit(t.title).alias("title"),
        )))
    out = df.select(id_col, F.posexplode(F.array_compact(F.array(*rows))).alias("position", "action"))
    return out.select(id_col, (F.col("position") + 1).cast("long").alias("position"), "action.*")


def intent(action_type: Column, title: Column) -> Column:
    """Type and purpose of an action; the start of its title where no purpose word occurs."""
    low = F.lower(title)
    name = None
    for purpose, words in INTENTS:
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        name = F.when(hit, purpose) if name is None else name.when(hit, purpose)
    return F.concat(action_type, F.lit(":"), name.otherwise(F.substring(title, 1, 25)))


def merge_actions(
    actions: DataFrame, id_col: str, position: str = "position", evidence: str = "evidence", hazard: str = "hazard"
) -> DataFrame:
    """One action per (report, intent): the first one, the highest urgency, evidence and hazards joined."""
    keyed = actions.withColumn("intent", intent(F.col("action_type"), F.col("title")))
    level = F.coalesce(*[F.when(F.col("urgency") == u, F.lit(i)) for i, u in enumerate(URGENCY_ORDER)], F.lit(9))

    def joined(column: str, sep: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(column).alias("v"))))
        return F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["v"])), sep)

    merged = keyed.groupBy(id_col, "intent").agg(
        F.min(F.struct(position, "action_id", "title", "action_type")).alias("_first"),
        F.min(F.struct(level.alias("level"), "urgency"))["urgency"].alias("urgency"),
        joined(evidence, " | ").alias("evidence"), joined(hazard, ", ").alias("hazards"),
        F.count(F.lit(1)).alias("merged"),
    )
    return merged.select(
        id_col, "intent", "_first.action_id", "_first.title", "_first.action_type", "urgency", "evidence", "hazards", "merged"
    )
