"""Human review: three-way reconciliation, rubric, analytics, provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.codes import percent
from wardline.operators.ranking import latest_per
from wardline.rules.reasoning import HIGH_CONSEQUENCE_RULES

# Fixed values.
DECISION_WORDS = {
    "PSIF": ("PSIF", "IS_PSIF", "TRUE", "1"),
    "NOT_PSIF": ("NOT_PSIF", "NON_PSIF", "FALSE", "0"),
    "INSUFFICIENT_INFORMATION": ("INSUFFICIENT_INFORMATION", "INSUFFICIENT", "UNCERTAIN", "UNKNOWN"),
}
RUBRIC = {
    "A_hazard": ("present", "absent", "unclear"),
    "B_exposure": ("exposed", "not_exposed", "unclear"),
    "C_control": ("effective", "failed_or_absent", "degraded", "unclear"),
    "D_consequence": ("credible_sif", "minor_only", "unclear"),
    "E_escalation": ("plausible_escalation", "unlikely_escalation", "unclear"),
    "F_sufficiency": ("sufficient", "insufficient"),
}
DECISIONS = ("PSIF", "NOT_PSIF", "INSUFFICIENT_INFORMATION")


def decision_label(value: Column) -> Column:
    """Canonical decision of a spelling; unknown spellings stay as upper-case words."""
    key = F.translate(F.upper(F.trim(value.cast("string"))), " -", "__")
    found = F.coalesce(*[F.when(key.isin(*words), F.lit(label)) for label, words in DECISION_WORDS.items()])
    return F.coalesce(found, key)


def rule_agreement(
    df: DataFrame, predicted: str, rules: str, serious: Sequence[str] = HIGH_CONSEQUENCE_RULES
) -> DataFrame:
    """Adds the rule verdict (any high-consequence rule), agreement with the model and the policy."""
    rule = F.arrays_overlap(F.col(rules), F.array(*[F.lit(r) for r in serious]))
    df = df.withColumn("rule_psif", F.coalesce(rule, F.lit(False)))
    same = F.coalesce(F.col(predicted), F.lit(False)) == F.col("rule_psif")
    policy = F.when(~same, "HUMAN_ADJUDICATION_REQUIRED").when(F.col("rule_psif"), "PROCEED_TO_INVESTIGATION").otherwise(
        "ROUTINE_MONITORING"
    )
    return df.withColumns({"agrees": same, "policy": policy})


def reconcile3(df: DataFrame, human: str, model: str, rule: str) -> DataFrame:
    """Adds pairwise relations of human, model and rule, and the overall state."""
    h = F.coalesce(decision_label(F.col(human)), F.lit("INSUFFICIENT_INFORMATION"))
    df = df.withColumns({"_h": h, "_m": decision_label(F.col(model)), "_r": decision_label(F.col(rule))})
    h, m, r = F.col("_h"), F.col("_m"), F.col("_r")
    insufficient = h == "INSUFFICIENT_INFORMATION"

    def relation(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | b.isNull(), "NOT_APPLICABLE").when(a == b, "AGREE").otherwise("DISAGREE")

    both = m.isNotNull() & r.isNotNull()
    state = (
        F.when(insufficient, "HUMAN_INSUFFICIENT_INFORMATION")
        .when(both & (h == m) & (h == r), "MODEL_RULE_HUMAN_TRIPLE_AGREEMENT")
        .when(both & (h == r), "HUMAN_OVERRIDES_MODEL")
        .when(both & (h == m), "HUMAN_OVERRIDES_RULE")
        .when(both & (m != r), "THREE_WAY_DISAGREEMENT")
        .when(both, "HUMAN_OVERRIDES_MODEL")
        .when((h == m) | (h == r) | (m.isNull() & r.isNull()), "AGREEMENT")
        .when(m.isNotNull(), "HUMAN_OVERRIDES_MODEL")
        .otherwise("HUMAN_OVERRIDES_RULE")
    )
    return df.withColumns({
        "model_vs_human": F.when(insufficient, "HUMAN_INSUFFICIENT").otherwise(relation(m, h)),
        "rule_vs_human": F.when(insufficient, "HUMAN_INSUFFICIENT").otherwise(relation(r, h)),
        "model_vs_rule": relation(m, r),
        "reconciliation": state,
    }).drop("_h", "_m", "_r")


def score_rubric(df: DataFrame, answers: str = "rubric_answers") -> DataFrame:
    """Adds ``rubric_decision`` from the six answers (map column)."""
    get = lambda key: F.try_element_at(F.col(answers), F.lit(key))
    hazard, exposure, control = get("A_hazard"), get("B_exposure"), get("C_control")
    outcome, escalation = get("D_consequence"), get("E_escalation")
    is_ = lambda c, *values: F.coalesce(c.isin(*values), F.lit(False))
    psif = (
        is_(hazard, "present") & is_(outcome, "credible_sif")
        & (is_(exposure, "exposed") | is_(escalation, "plausible_escalation"))
        & is_(control, "failed_or_absent", "degraded", "unclear")
    )
    unlikely = is_(escalation, "unlikely_escalation")
    safe = (
        is_(hazard, "absent") | (is_(outcome, "minor_only") & unlikely)
        | (is_(control, "effective") & is_(exposure, "not_exposed") & unlikely)
    )
    unclear = is_(hazard, "unclear") | is_(exposure, "unclear") | is_(outcome, "unclear")
    decision = (
        F.when(is_(get("F_sufficiency"), "insufficient"), "INSUFFICIENT_INFORMATION")
        .when(psif, "PSIF").when(safe, "NOT_PSIF").when(unclear, "INSUFFICIENT_INFORMATION")
        .when(is_(outcome, "credible_sif") | is_(escalation, "plausible_escalation"), "PSIF")
        .otherwise("NOT_PSIF")
    )
    return df.withColumn("rubric_decision", decision)


def check_rubric(
    df: DataFrame, answers: str = "rubric_answers", rubric: Mapping[str, Sequence[str]] = RUBRIC
) -> DataFrame:
    """Adds ``rubric_errors``: criteria whose answer is none of its options."""
    bad = []
    for key, options in rubric.items():
        value = F.try_element_at(F.col(answers), F.lit(key))
        bad.append(F.when(value.isNotNull() & ~value.isin(*options), F.lit(key)))
    return df.withColumn("rubric_errors", F.array_compact(F.array(*bad)))


def review_analytics(
    df: DataFrame, reviews: DataFrame, id_col: str = "incident_id", created: str = "created_at"
) -> DataFrame:
    """(measure, n, base, pct): coverage, decision mix, agreement with model, rule and both, states.

    ``df`` has ``predicted`` and ``rule_decision``; the latest review of an incident counts. Every
    share carries its denominator.
    """
    mix = reviews.agg(F.count(F.lit(1)).alias("_reviews"), *[F.count_if(F.col("decision") == d).alias(f"_{d}") for d in DECISIONS])
    last = latest_per(reviews.select(id_col, created, "decision"), [id_col], [created])
    joined = df.select(id_col, "predicted", "rule_decision").join(last.select(id_col, "decision"), id_col, "left")
    done = reconcile3(joined, "decision", "predicted", "rule_decision")
    seen = F.col("decision").isNotNull()
    has_model, has_rule = seen & F.col("predicted").isNotNull(), seen & F.col("rule_decision").isNotNull()
    state = F.col("reconciliation")
    states = (
        "MODEL_RULE_HUMAN_TRIPLE_AGREEMENT", "HUMAN_OVERRIDES_MODEL", "HUMAN_OVERRIDES_RULE",
        "HUMAN_INSUFFICIENT_INFORMATION", "THREE_WAY_DISAGREEMENT", "AGREEMENT",
    )
    totals = done.agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(seen).alias("_seen"),
        F.count_if(has_model).alias("_m"), F.count_if(has_model & (F.col("model_vs_human") == "AGREE")).alias("_ma"),
        F.count_if(has_rule).alias("_r"), F.count_if(has_rule & (F.col("rule_vs_human") == "AGREE")).alias("_ra"),
        F.count_if(has_model & has_rule).alias("_t"), F.count_if(has_model & has_rule & (state == states[0])).alias("_ta"),
        *[F.count_if(seen & (state == s)).alias(f"_s{i}") for i, s in enumerate(states)],
    )
    counts = totals.select("*", mix.agg(F.first(F.struct("*"))).scalar().alias("_mix"))
    rows = [
        ("coverage", F.col("_seen"), F.col("_all")),
        *[(f"decision:{d}", F.col(f"_mix._{d}"), F.col("_mix._reviews")) for d in DECISIONS],
        ("model_vs_human", F.col("_ma"), F.col("_m")), ("rule_vs_human", F.col("_ra"), F.col("_r")),
        ("triple_agreement", F.col("_ta"), F.col("_t")),
        *[(f"state:{s}", F.col(f"_s{i}"), F.col("_seen")) for i, s in enumerate(states)],
    ]
    long = counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("measure"), n.alias("n"), base.alias("base")) for name, n, base in rows
    ])))
    return long.withColumn("pct", percent(F.col("n"), F.col("base")))


def provenance(
    df: DataFrame,
    synthetic: str = "is_synthetic",
    simulated: str = "is_simulated",
    reviewer: str = "reviewer",
    reviewed_at: str = "reviewed_at",
    decision: str = "human_decision",
    label: str = "human_label",
    source: str = "label_source",
    raw_label: str = "raw_label",
) -> DataFrame:
    """Adds ``provenance``, ``eligibility`` and ``effective_label``.

    Simulated reviews never count as human; insufficient information is never turned into a negative.
    """
    is_syn = F.coalesce(F.col(synthetic), F.lit(False))
    is_sim = F.coalesce(F.col(simulated), F.lit(False))
    dec, lab, src = F.col(decision), F.col(label), F.coalesce(F.col(source), F.lit("none"))
    decided = F.coalesce(dec.isin(*DECISIONS), F.lit(False)) | lab.isNotNull()
    approved = is_syn & ~is_sim & F.col(reviewer).isNotNull() & F.col(reviewed_at).isNotNull() & decided
    human = approved | src.isin("human_approved_synthetic", "real_human")
    category = (
        F.when(approved | (is_syn & (src == "human_approved_synthetic")), "HUMAN_APPROVED_SYNTHETIC")
        .when(~is_syn & (src == "real_external"), "REAL_EXTERNAL")
        .when(~is_syn & (src == "real_human"), "REAL_HUMAN")
        .when(is_syn, "SYNTHETIC")
        .otherwise("UNKNOWN_UNLABELLED")
    )
    eligibility = (
        F.when(is_sim, "UNREVIEWED")
        .when(dec == "PSIF", "HUMAN_PSIF").when(dec == "NOT_PSIF", "HUMAN_NOT_PSIF")
        .when(dec == "INSUFFICIENT_INFORMATION", "HUMAN_INSUFFICIENT_INFORMATION")
        .when(lab & human, "HUMAN_PSIF").when(~lab & human, "HUMAN_NOT_PSIF")
        .otherwise("UNREVIEWED")
    )
    raw = F.lower(F.col(raw_label).cast("string"))
    effective = (
        F.when(is_sim, F.lit(None).cast("boolean"))
        .when(dec == "PSIF", F.lit(True)).when(dec == "NOT_PSIF", F.lit(False))
        .when(dec == "INSUFFICIENT_INFORMATION", F.lit(None).cast("boolean"))
        .when(lab.isNotNull() & human, lab)
        .when(is_syn & raw.isin("1", "true"), F.lit(True)).when(is_syn & raw.isin("0", "false"), F.lit(False))
    )
    return df.withColumns({"provenance": category, "eligibility": eligibility, "effective_label": effective})
