"""Hazard, exposure, control and consequence of a report, the rule decision, and its reconciliation
with the model score. Every step adds columns; no step shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.patterns import may_match
from wardline.functions.text import add_lines, contains_any, first_span, is_sparse, line_match, strip
from wardline.plans.scale import once
from wardline.rules import reasoning as fixed
from wardline.rules.reasoning import RuleBook


@dataclass(frozen=True)
class ReasoningColumns:
    """Where the reasoning finds its inputs; ``None`` for what the source lacks."""

    narrative: str
    energy_type: str | None = None
    job_task: str | None = None
    injury_type: str | None = None
    body_part: str | None = None
    control_type: str | None = None
    control_condition: str | None = None
    control_failed: str | None = None
    book: RuleBook = field(default_factory=RuleBook)

    def low(self, name: str) -> Column:
        column = getattr(self, name)
        return F.lit("") if column is None else F.lower(strip(F.coalesce(F.col(column).cast("string"), F.lit(""))))

    def flag(self, name: str) -> Column:
        column = getattr(self, name)
        return F.lit(False) if column is None else F.coalesce(F.col(column), F.lit(False))


def prepare(df: DataFrame, cols: ReasoningColumns) -> DataFrame:
    """Adds the sentence lines, lower-cased narrative and sparse flag the steps share."""
    text = F.coalesce(F.col(cols.narrative), F.lit(""))
    return add_lines(once(df, _low=F.lower(text), is_sparse=is_sparse(text)), text)


def detect_hazards(df: DataFrame, cols: ReasoningColumns) -> DataFrame:
    """Adds ``hazard``, ``energy_present``, ``hazard_source``, ``hazard_span`` and ``all_hazards``.

    Structured energy comes first, then the job task, then the narrative families in order.
    """
    lines, book = F.col("_lines"), cols.book
    hits = F.array_compact(F.array(*[F.when(line_match(lines, p, "_guard"), F.lit(h)) for h, p in book.hazards.items()]))
    energy = F.replace(cols.low("energy_type"), F.lit("_"), F.lit(" "))
    by_energy = F.coalesce(
        *[F.when(energy.contains(word), F.lit(h)) for word, h in fixed.ENERGY_HAZARDS], F.lit(fixed.ENERGY_DEFAULT)
    )
    task = cols.low("job_task")
    by_task = F.coalesce(*[F.when(contains_any(task, words), F.lit(h)) for words, h in book.task_hazards])
    df = once(
        df, _hits=hits, _energy=F.when(~energy.isin(*fixed.NO_ENERGY), by_energy),
        _task=F.when(~task.isin(*fixed.NO_TASK), by_task),
    )
    structured = F.coalesce("_energy", "_task")
    found = F.get("_hits", F.lit(0))
    df = df.withColumns({
        "hazard": F.coalesce(structured, found, F.lit(fixed.LOW_ENERGY)),
        "energy_present": structured.isNotNull() | found.isNotNull(),
        "hazard_source": F.when(F.col("_energy").isNotNull(), "energy_type").when(F.col("_task").isNotNull(), "job_task")
        .otherwise("composite_narrative"),
        "all_hazards": F.when(structured.isNull() & found.isNull(), F.array(F.lit(fixed.LOW_ENERGY))).otherwise(
            F.array_distinct(F.concat(F.when(structured.isNotNull(), F.array(structured))
                                      .otherwise(F.array().cast("array<string>")), F.col("_hits")))
        ),
    })
    span = F.coalesce(*[F.when(F.col("hazard") == h, first_span(lines, p, low="_guard")) for h, p in book.hazards.items()])
    text = F.when(F.col("_energy").isNotNull(), F.concat(F.lit("Structured energy: "), energy)).when(
        F.col("_task").isNotNull(), F.concat(F.lit("Structured job task: "), task)
    ).otherwise(span)
    return once(df, hazard_span=text).drop("_hits", "_energy", "_task")


def exposure_state(df: DataFrame, cols: ReasoningColumns) -> DataFrame:
    """Adds ``exposure_state``, ``exposure_span``: interrupted, safe, direct, injury-implied, sparse, potential."""
    lines, book = F.col("_lines"), cols.book
    df = once(
        df, _interrupted=first_span(lines, book.interrupted, low="_guard"), _safe=first_span(lines, book.safe, low="_guard"),
        _direct=first_span(lines, book.direct, low="_guard"),
    )
    injured = ~cols.low("injury_type").isin(*fixed.NO_INJURY) | ~cols.low("body_part").isin(*fixed.NO_INJURY)
    safe, direct = F.lower("_safe"), F.lower("_direct")
    state = (
        F.when(F.col("_interrupted").isNotNull(), "EXPOSURE_INTERRUPTED")
        .when(
            F.col("_safe").isNotNull(),
            F.when(contains_any(safe, book.absent_words), "NO_WORKER_EXPOSURE").otherwise("NEARBY_BUT_PROTECTED"),
        )
        .when(
            F.col("_direct").isNotNull(),
            F.when(contains_any(direct, book.path_words), "IN_RELEASE_PATH")
            .when(contains_any(direct, book.zone_words), "INSIDE_EXCLUSION_ZONE").otherwise("DIRECT_EXPOSURE"),
        )
        .when(injured, "DIRECT_EXPOSURE")
        .when(F.col("is_sparse"), "UNKNOWN")
        .otherwise("POTENTIAL_EXPOSURE")
    )
    span = F.coalesce("_interrupted", "_safe", "_direct", F.when(injured, F.lit("Structured injury recorded")))
    return df.withColumns({"exposure_state": state, "exposure_span": span}).drop("_interrupted", "_safe", "_direct")


def control_state(df: DataFrame, cols: ReasoningColumns) -> DataFrame:
    """Adds ``control_state``, ``control_span``, ``control_tier`` and ``is_direct_control``.

    Structured condition first, then the narrative. Ordinary protective equipment alone is no barrier.
    """
    lines, book = F.col("_lines"), cols.book
    df = once(
        df, _eff=first_span(lines, book.effective, low="_guard"), _fail=first_span(lines, book.compromised, low="_guard"),
        _ppe=line_match(lines, book.ppe, "_guard"), _after=line_match(lines, book.restored_after, "_guard"),
        _rec=line_match(lines, book.recommended, "_guard"), _plan=line_match(lines, book.planned, "_guard"),
    )
    condition, kind, failed = cols.low("control_condition"), cols.low("control_type"), cols.flag("control_failed")
    eff, fail, low = F.col("_eff").isNotNull(), F.col("_fail").isNotNull(), F.lower("_fail")
    broken = failed | condition.isin("failed", "bypassed", "absent")
    held = condition.isin("effective", "held")
    state = (
        F.when(
            broken,
            F.when(condition == "bypassed", "BYPASSED").when(condition == "absent", "ABSENT").otherwise("FAILED"),
        )
        .when(held, "EFFECTIVE")
        .when(eff & ~fail, "EFFECTIVE")
        .when(
            fail & ~eff,
            F.when(low.contains("bypassed"), "BYPASSED")
            .when(contains_any(low, ("not applied", "missing", "no loto")), "ABSENT")
            .when(low.contains("not verified"), "NOT_VERIFIED").otherwise("FAILED"),
        )
        .when(eff & fail, "FAILED")
        .when(F.col("exposure_state") == "EXPOSURE_INTERRUPTED", "RESTORED_BEFORE_EXPOSURE")
        .when(F.col("_after"), "RESTORED_AFTER_EXPOSURE")
        .when(F.col("_rec"), "RECOMMENDATION_ONLY")
        .when(F.col("_plan"), "PLANNED_ONLY")
        .otherwise("UNKNOWN")
    )
    df = df.withColumn("_state", state)
    only_ppe = (F.col("_ppe") | contains_any(kind, fixed.PPE_WORDS)) & ~eff
    override = only_ppe & F.col("_state").isin("UNKNOWN", "EFFECTIVE")
    tier = (
        F.when(only_ppe, "PPE").when(contains_any(kind, fixed.PROCEDURAL_WORDS), "PROCEDURAL_CONTROL")
        .when(contains_any(kind, fixed.ADMINISTRATIVE_WORDS), "ADMINISTRATIVE_CONTROL")
        .otherwise("DIRECT_ENGINEERED_CONTROL")
    )
    span = (
        F.when(override, "Only ordinary protective equipment; no engineered barrier")
        .when(broken | held, F.concat(F.lit("Structured condition: "), condition))
        .otherwise(F.coalesce("_fail", "_eff"))
    )
    return df.withColumns({
        "control_span": span,
        "control_tier": tier,
        "is_direct_control": (kind != "") & ~kind.contains("indirect") & ~only_ppe,
        "control_state": F.when(override, "ABSENT").otherwise(F.col("_state")),
    }).drop("_eff", "_fail", "_ppe", "_after", "_rec", "_plan", "_state")


def contradictions(df: DataFrame, cols: ReasoningColumns) -> DataFrame:
    """Adds ``contradiction`` (first pair of claims that exclude each other); it voids an effective control."""
    low = F.col("_low")

    def holds(pattern: str) -> Column:
        guard = may_match(low, [pattern])
        hit = low.rlike(f"(?U){pattern}")
        return hit if guard is None else F.when(guard, hit).otherwise(F.lit(False))

    first = F.coalesce(*[F.when(holds(a) & holds(b), F.lit(name)) for name, a, b in cols.book.contradictions])
    df = once(df, contradiction=first)
    voided = F.col("contradiction").isNotNull() & (F.col("control_state") == "EFFECTIVE")
    return df.withColumn("control_state", F.when(voided, "FAILED").otherwise(F.col("control_state")))


def consequence(df: DataFrame, cols: ReasoningColumns) -> DataFrame:
    """Adds ``mechanism`` (first family) and ``consequence_state``."""
    lines = F.col("_lines")
    mechanism = F.coalesce(*[F.when(line_match(lines, p, "_guard"), F.lit(m)) for m, p in cols.book.mechanisms.items()])
    exposure, control = F.col("exposure_state"), F.col("control_state")
    state = (
        F.when(F.col("contradiction").isNotNull(), "UNKNOWN")
        .when(~F.col("energy_present"), "NOT_ESTABLISHED")
        .when((control == "EFFECTIVE") | exposure.isin(*fixed.SAFE_EXPOSURES), "INTERRUPTED")
        .when(control.isin(*fixed.HARD_FAILURES) & exposure.isin(*fixed.OPEN_EXPOSURES), "SUPPORTED")
        .when(F.col("is_sparse") | (exposure == "UNKNOWN") | (control == "UNKNOWN"), "UNKNOWN")
        .otherwise("PARTIAL")
    )
    return once(df, mechanism=mechanism).withColumn("consequence_state", state)


def evidence_strength(df: DataFrame, cols: ReasoningColumns) -> DataFrame:
    """Adds ``missing_evidence`` (codes), ``facts`` (0 to 6) and ``evidence_strength``."""
    conflict = F.col("contradiction").isNotNull()
    missing = F.array_compact(F.array(
        F.when(conflict, F.lit("resolve_contradiction")),
        F.when(F.col("energy_present") & (F.col("control_state") == "UNKNOWN"), F.lit("control_state")),
        F.when(F.col("energy_present") & (F.col("exposure_state") == "UNKNOWN"), F.lit("worker_position")),
        F.when(F.col("is_sparse"), F.lit("complete_narrative")),
    ))
    known = [
        F.col("energy_present"), F.col("hazard_span").isNotNull(), F.col("exposure_state") != "UNKNOWN",
        F.col("control_state") != "UNKNOWN", cols.low("energy_type") != "", cols.low("control_type") != "",
    ]
    facts = sum((k.cast("int") for k in known), F.lit(0))
    df = df.withColumns({"missing_evidence": missing, "facts": facts})
    strength = (
        F.when(F.col("is_sparse") | (F.col("facts") <= 1) | conflict, "WEAK")
        .when((F.col("facts") >= 4) & (F.size("missing_evidence") == 0), "STRONG")
        .otherwise("MODERATE")
    )
    return df.withColumn("evidence_strength", strength)


def decide(df: DataFrame, cols: ReasoningColumns) -> DataFrame:
    """Adds ``internal_state``, ``decision`` and the id of the ``matched_rule``."""
    exposure, control, energy = F.col("exposure_state"), F.col("control_state"), F.col("energy_present")
    explicit = energy & control.isin(*fixed.EXPLICIT_CONTROLS) & exposure.isin(*fixed.OPEN_EXPOSURES, *fixed.SAFE_EXPOSURES)
    unsure = (F.col("is_sparse") & ~explicit) | (
        energy & ((exposure == "UNKNOWN") | ((control == "UNKNOWN") & (F.size("missing_evidence") >= 2)))
    )
    controlled = exposure.isin(*fixed.SAFE_EXPOSURES) | control.isin("EFFECTIVE", "RESTORED_BEFORE_EXPOSURE")
    state = (
        F.when(F.col("contradiction").isNotNull(), "CONFLICTING_EVIDENCE")
        .when(unsure, "INSUFFICIENT_INFORMATION")
        .when(~energy | (F.col("hazard") == fixed.LOW_ENERGY), "LOW_ENERGY")
        .when(controlled, "HIGH_ENERGY_CONTROLLED")
        .when(control.isin(*fixed.COMPROMISED) & exposure.isin(*fixed.OPEN_EXPOSURES), "PSIF_PATHWAY_OPEN")
        .otherwise("INSUFFICIENT_INFORMATION")
    )
    df = df.withColumn("internal_state", state)
    by_hazard: dict[str, str] = {}
    for rule, hazards in cols.book.open_rules:
        for hazard in hazards:
            by_hazard.setdefault(hazard, rule)
    opened = F.coalesce(
        *[F.when(F.col("hazard") == h, F.lit(r)) for h, r in by_hazard.items()], F.lit(fixed.FALLBACK_RULE)
    )
    halted = (exposure == "EXPOSURE_INTERRUPTED") | (control == "RESTORED_BEFORE_EXPOSURE")
    s = F.col("internal_state")
    rule = (
        F.when(s == "LOW_ENERGY", fixed.LOW_ENERGY_RULE)
        .when(s == "HIGH_ENERGY_CONTROLLED", F.when(halted, fixed.INTERRUPTED_RULE).otherwise(fixed.CONTROLLED_RULE))
        .when(s == "PSIF_PATHWAY_OPEN", opened)
    )
    decision = (
        F.when(s == "PSIF_PATHWAY_OPEN", "PSIF").when(s.isin("LOW_ENERGY", "HIGH_ENERGY_CONTROLLED"), "NOT_PSIF")
        .otherwise("INSUFFICIENT_INFORMATION")
    )
    return df.withColumns({"decision": decision, "matched_rule": rule})


def applicable_rules(df: DataFrame, hazard: str, book: fixed.RuleBook = fixed.RuleBook(), state: str | None = None) -> DataFrame:
    """Adds ``applicable_rules``: ids of the catalogue's rules for the hazard, in order; with ``state`` only those that lead
    to the state in that column. A hazard without rules, or a null one, gets an empty list.
    """
    rules = [F.struct(F.lit(rule).alias("rule"), F.lit(effect).alias("effect"), F.array(*[F.lit(h) for h in hazards]).alias("hazards"))
             for rule, effect, hazards in book.catalogue()]
    fits = lambda r: F.array_contains(r["hazards"], F.col(hazard)) & (F.lit(True) if state is None else r["effect"] == F.col(state))
    found = F.transform(F.filter(F.array(*rules), fits), lambda r: r["rule"])
    return df.withColumn("applicable_rules", F.coalesce(found, F.array().cast("array<string>")))


def assess(df: DataFrame, cols: ReasoningColumns) -> DataFrame:
    """All steps in order; the helper columns are dropped at the end."""
    df = prepare(df, cols)
    for step in (
        detect_hazards, exposure_state, control_state, contradictions, consequence, evidence_strength, decide,
    ):
        df = step(df, cols)
    return df.drop("_lines", "_low", "_guard")


def reconcile(
    df: DataFrame, predicted: str = "predicted", quality: str | None = None
) -> DataFrame:
    """Adds ``agreement_state``, ``disagreement_type``, ``review_needed`` and ``final_decision``.

    A critical quality status or missing evidence blocks; else the rule decides, and a model that
    differs raises the review flag.
    """
    blocked = F.lit(False) if quality is None else F.coalesce(F.col(quality) == "CRITICAL", F.lit(False))
    rule = F.col("decision")
    model = F.when(F.col(predicted), "PSIF").when(~F.col(predicted), "NOT_PSIF")
    unsure = rule == "INSUFFICIENT_INFORMATION"
    agreement = (
        F.when(blocked, "DATA_QUALITY_BLOCKED").when(unsure, "INSUFFICIENT_EVIDENCE")
        .when(model.isNull() | (model == rule), "MODEL_AND_RULE_AGREE")
        .when(rule == "PSIF", "RULE_EVIDENCE_STRONGER_THAN_MODEL").otherwise("MODEL_STRONGER_THAN_RULE_EVIDENCE")
    )
    df = df.withColumn("agreement_state", agreement)
    state = F.col("agreement_state")
    return df.withColumns({
        "disagreement_type": F.when(state == "RULE_EVIDENCE_STRONGER_THAN_MODEL", "POTENTIAL_FALSE_NEGATIVE").when(
            state == "MODEL_STRONGER_THAN_RULE_EVIDENCE", "POTENTIAL_FALSE_POSITIVE"
        ),
        "review_needed": state != "MODEL_AND_RULE_AGREE",
        "final_decision": F.when(blocked, "INSUFFICIENT_INFORMATION").otherwise(rule),
    })
