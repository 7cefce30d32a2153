"""Evidence chain, inference guards, completeness, barrier linkage, sufficiency and score strength."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import contains_any, first_span, line_match
from wardline.plans.scale import once
from wardline.rules.contracts import CONTRACTS
from wardline.rules.evidence import (
    CHAIN,
    CONTROL_TERMS,
    CONTROL_WORDS,
    LINKS,
    PLAN_WORDS,
    POSITION_TERMS,
    PPE_MENTIONS,
    VIOLATION_WORDS,
    ChainPatterns,
)

def evidence_chain(
    df: DataFrame,
    patterns: ChainPatterns,
    energy_type: Column,
    high_energy: Column,
    worker_exposed: Column,
    condition: Column,
    failed: Column,
    potential: Column,
    predicted: Column,
) -> DataFrame:
    """Adds the state of the five links, counts per state and the named breaks.

    Needs ``_lines``, ``_guard`` and ``is_sparse`` from ``reasoning.prepare``. States are SUPPORTED, PARTIAL,
    UNCERTAIN and MISSING.
    """
    lines, sparse = F.col("_lines"), F.col("is_sparse")
    flat = lambda sets: [p for group in sets.values() for p in group]
    df = once(
        df, _energy=line_match(lines, flat(patterns.energy), "_guard"), _exp=line_match(lines, patterns.exposure, "_guard"),
        _noexp=line_match(lines, patterns.no_exposure, "_guard"), _fail=line_match(lines, patterns.failure, "_guard"),
        _eff=line_match(lines, patterns.effective, "_guard"), _mech=line_match(lines, flat(patterns.mechanisms), "_guard"),
    )
    text = lambda c: F.coalesce(c, F.lit(""))
    structured = (text(high_energy) == "yes") | ~text(energy_type).isin("unknown", "", "none", "other")
    hazard = F.when(structured | F.col("_energy"), "SUPPORTED").when(sparse, "UNCERTAIN").otherwise("MISSING")
    exposed = text(worker_exposed)
    exposure = (
        F.when(F.col("_noexp"), "MISSING")
        .when((exposed == "yes") | (F.col("_exp") & (exposed != "no")), "SUPPORTED")
        .when(F.col("_exp") & (exposed == "no"), "MISSING")
        .when(sparse, "UNCERTAIN").otherwise("MISSING")
    )
    broken = text(condition).isin("failed", "bypassed", "absent") | F.coalesce(failed, F.lit(False))
    # an effective cue overrides a structured failure unless the narrative tells of a new failure
    control = (
        F.when(F.col("_fail") & ~broken, "SUPPORTED").when(F.col("_eff"), "MISSING").when(broken, "SUPPORTED")
        .when(sparse, "UNCERTAIN").otherwise("MISSING")
    )
    outcome = (
        F.when(F.col("_mech"), "SUPPORTED").when(text(potential).isin("serious", "fatality"), "PARTIAL")
        .when(sparse, "UNCERTAIN").otherwise("MISSING")
    )
    df = df.withColumns({
        "hazard_link": hazard, "exposure_link": exposure, "control_link": control, "consequence_link": outcome,
    })
    both = (F.col("hazard_link") == "SUPPORTED") & (F.col("consequence_link") == "SUPPORTED")
    df = df.withColumn("escalation_link", F.when(both, "SUPPORTED").when(sparse, "UNCERTAIN").otherwise("MISSING"))
    open_ = lambda link: F.col(f"{link}_link").isin("MISSING", "UNCERTAIN")
    breaks = F.array_compact(F.array(
        F.when(sparse, F.lit("sparse_narrative")),
        F.when(open_("hazard"), F.lit("hazard_missing")),
        F.when((F.col("hazard_link") == "SUPPORTED") & open_("exposure"), F.lit("exposure_missing")),
        F.when(open_("control") & ~sparse, F.lit("control_intact")),
        F.when(open_("consequence") & ~sparse, F.lit("consequence_missing")),
    ))
    links = [F.col(f"{link}_link") for link in LINKS]
    counted = {
        f"n_{state.lower()}": sum(((c == state).cast("long") for c in links), F.lit(0).cast("long"))
        for state in ("SUPPORTED", "PARTIAL", "UNCERTAIN", "MISSING")
    }
    df = df.withColumns({**counted, "_breaks": breaks})
    complete = (F.size("_breaks") == 0) & predicted
    return df.withColumn(
        "breaks", F.when(complete, F.array(F.lit("none_supported_psif"))).otherwise(F.col("_breaks"))
    ).drop("_energy", "_exp", "_noexp", "_fail", "_eff", "_mech", "_breaks")


def anti_inference(
    df: DataFrame, low: Column, hazard: Column, exposure: Column, control: Column, rules: Column
) -> DataFrame:
    """Adds ``guards``: the inferences that must not be drawn from this report."""
    checks = {
        "HAZARD_MENTION_NOT_EXPOSURE": hazard & exposure.isin(
            "UNKNOWN", "INSUFFICIENT_INFORMATION", "NO_EXPOSURE", "PROTECTED_POSITION"),
        "RULE_MATCH_NOT_VIOLATION": (F.size(rules) > 0) & ~contains_any(low, VIOLATION_WORDS),
        "CONTROL_MENTION_NOT_EFFECTIVENESS": contains_any(low, CONTROL_WORDS) & control.isin(
            "UNKNOWN", "NOT_VERIFIED", "INCORRECTLY_ASSUMED"),
        "PLANNED_ACTION_NOT_COMPLETED_CONTROL": contains_any(low, PLAN_WORDS),
        "PPE_USE_NOT_DIRECT_CONTROL": contains_any(low, PPE_MENTIONS),
        "HIGH_ENERGY_EQUIPMENT_NOT_PSIF": hazard & control.isin("EFFECTIVE", "VERIFIED"),
    }
    return once(df, guards=F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in checks.items()])))


def completeness(
    df: DataFrame,
    hazard: str = "hazard",
    exposure: str = "exposure_state",
    control: str = "control_state",
    contracts: Mapping[str, tuple[int, Mapping[str, str]]] = CONTRACTS,
) -> DataFrame:
    """Adds ``completeness``, ``missing_items`` and ``prompts`` from the contract of the hazard."""
    no_position = F.col(exposure).isin("UNKNOWN", "INSUFFICIENT_INFORMATION")
    no_control = F.col(control).isin("UNKNOWN", "NOT_VERIFIED", "INCORRECTLY_ASSUMED")
    missing = F.array_compact(F.array(
        F.when(no_position, F.lit("worker_position")), F.when(no_control, F.lit("control_verification"))
    ))
    required = F.coalesce(*[F.when(F.col(hazard) == h, F.lit(n)) for h, (n, _) in contracts.items()])

    def listed(terms: Sequence[str] | None) -> Column:
        chosen = []
        for h, (_, prompts) in contracts.items():
            texts = [p for key, p in prompts.items() if terms is None or any(t in key for t in terms)]
            chosen.append(F.when(F.col(hazard) == h, F.array(*[F.lit(p) for p in texts]).cast("array<string>")))
        return F.coalesce(*chosen, F.array().cast("array<string>"))

    none = F.array().cast("array<string>")
    asked = F.concat(
        F.when(no_position, listed(POSITION_TERMS)).otherwise(none), F.when(no_control, listed(CONTROL_TERMS)).otherwise(none)
    )
    df = df.withColumns({"missing_items": missing, "_required": required, "_asked": asked})
    n = F.size("missing_items")
    level = (
        F.when(F.col("_required").isNull(), "UNKNOWN").when(n == 0, "COMPLETE").when(n < F.col("_required"), "PARTIAL")
        .otherwise("INSUFFICIENT")
    )
    prompts = F.when((n > 0) & (F.size("_asked") == 0), listed(None)).otherwise(F.col("_asked"))
    items = F.when(F.col("_required").isNull(), none).otherwise(F.col("missing_items"))
    return df.withColumns({"completeness": level, "prompts": prompts}).withColumn("missing_items", items).drop("_required", "_asked")


def barrier_linkage(
    df: DataFrame,
    effective: Sequence[str],
    compromised: Sequence[str],
    condition: Column,
    failed: Column,
    predicted: Column,
) -> DataFrame:
    """Adds ``linkage``, ``linkage_evidence`` and ``pathway_role``; needs ``_lines`` and ``_guard``."""
    lines = F.col("_lines")
    df = once(df, _eff=first_span(lines, effective, low="_guard"), _fail=first_span(lines, compromised, low="_guard"))
    low = F.lower(F.coalesce(condition, F.lit("")))
    broken = F.coalesce(failed, F.lit(False)) | low.isin("failed", "bypassed", "absent")
    held = low.contains("effective") | (low == "held")
    eff, fail = F.col("_eff").isNotNull(), F.col("_fail").isNotNull()
    linkage = (
        F.when(broken, "COMPROMISED").when(held, "CONTROLLED").when(fail & ~eff, "COMPROMISED")
        .when(eff & ~fail, "CONTROLLED").when(eff & fail, "PARTIALLY_EFFECTIVE").otherwise("UNKNOWN")
    )
    df = df.withColumns({
        "linkage": linkage,
        "linkage_evidence": F.when(broken | held, F.concat(F.lit("Structured condition: "), low)).otherwise(
            F.coalesce("_fail", "_eff")),
    })
    role = F.when(
        predicted, F.when(F.col("linkage") == "COMPROMISED", "Primary Barrier Precursor").otherwise("Operational Hazard Context")
    ).otherwise(F.when(F.col("linkage") == "CONTROLLED", "Capacity / Controlled Energy").otherwise("Defended / Low Risk"))
    return df.withColumn("pathway_role", role).drop("_eff", "_fail")


def sufficiency(
    df: DataFrame, has_prediction: Column, sparse: Column, critical: Column, has_vector: Column, department: Column
) -> DataFrame:
    """Adds a status for each analysis: psif, similarity, recurrence and rules."""
    warned = F.when(F.coalesce(critical, F.lit(False)), "AVAILABLE_WITH_WARNING").otherwise("AVAILABLE")
    blank = F.coalesce(department, F.lit("")) == ""
    return df.withColumns({
        "psif_status": F.when(~has_prediction, "NOT_AVAILABLE").when(sparse, "INSUFFICIENT_EVIDENCE").otherwise(warned),
        "similarity_status": F.when(sparse, "NOT_RUN").when(~has_vector, "NOT_READY").otherwise(warned),
        "recurrence_status": F.when(blank, "NOT_RUN").otherwise(warned),
        "rule_status": warned,
    })


def score_strength(
    df: DataFrame,
    score: Column,
    threshold: float,
    predicted: Column,
    sparse: Column,
    elements: Sequence[Column],
    fields: Mapping[str, str],
) -> DataFrame:
    """Adds ``score_strength`` (Strong / Moderate / Weak) and ``missing_information``.

    ``elements`` are the confirmed energy, exposure and control failure; ``fields`` names the columns
    whose absence is reported.
    """
    confirmed = sum((e.cast("int") for e in elements), F.lit(0))
    absent = F.lit(len(elements)) - confirmed
    # distances in ten-thousandths, so that a score exactly at the limit counts
    gap = F.floor((score - threshold) * 10000 + 0.5)
    yes = F.when((confirmed >= 2) & (gap >= 2000), "Strong").when((confirmed >= 1) | (gap >= 500), "Moderate")
    no = F.when((absent >= 2) & (-gap >= 2000), "Strong").when((absent >= 1) & (-gap >= 500), "Moderate")
    strength = F.when(sparse, "Weak").when(predicted, yes.otherwise("Weak")).otherwise(no.otherwise("Weak"))
    unknown = [
        F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "unknown"), F.lit(name)) for name, c in fields.items()
    ]
    return df.withColumns({
        "score_strength": strength,
        "missing_information": F.array_compact(F.array(*unknown, F.when(sparse, F.lit("narrative")))),
    })
