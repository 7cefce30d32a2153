"""Reasoning, evidence, review and action operators over the documents, with rule books whose words
occur in them."""

from pyspark.sql import functions as F

from wardline.operators import actions as a
from wardline.operators import evidence as ev
from wardline.operators import reasoning as r
from wardline.operators import review as rv
from wardline.queries.b_filters import SCORED
from wardline.queries.i_evaluation import REVIEWS, conversation_reviews
from wardline.queries.registry import query
from wardline.queries.sqltext import lines_sql, pct_sql, span_sql, sparse_sql
from wardline.rules.reasoning import RuleBook

BOOK = RuleBook(
    hazards={"h_one": (r"tion\s+the\s+in", r"zzz"), "h_two": (r"que\s+le\s+la",), "h_three": (r"ere\s+and",), "h_four": (r"er\s+das",)},
    task_hazards=((("crane", "rigging"), "h_lift"), (("weld",), "h_hot")),
    interrupted=(r"is\s+the\s+of",), safe=(r"on\s+and\s+the", r"les\s+que"), direct=(r"in\s+the\s+th", r"ent\s+la", r"ung\s+die"),
    absent_words=("and the t",), path_words=("tion",), zone_words=("is",),
    effective=(r"and\s+is", r"el\s+de"), compromised=(r"to\s+the", r"que\s+de", r"en\s+der"), ppe=(r"was\s+the\s+a",),
    restored_after=(r"as\s+for",), recommended=(r"du\s+la",), planned=(r"los\s+el",),
    contradictions=(("c_one", r"of the to", r"in and"), ("c_two", r"que un", r"la les")),
    mechanisms={"m_one": (r"for\s+of",), "m_two": (r"une\s+la",), "m_three": (r"that",)},
    open_rules=(("R-1", ("h_two", "h_lift")), ("R-2", ("h_lift", "h_one")), ("R-3", ("pressure_stored",))),
)
RE = {  # the same patterns inside one-blank lines
    "h_one": "tion the in|zzz", "h_two": "que le la", "h_three": "ere and", "h_four": "er das",
    "interrupted": "is the of", "safe": "on and the|les que", "direct": "in the th|ent la|ung die",
    "effective": "and is|el de", "compromised": "to the|que de|en der", "ppe": "was the a",
    "after": "as for", "rec": "du la", "plan": "los el", "m_one": "for of", "m_two": "une la", "m_three": "that",
}

STRUCT = """case doc_id % 9 when 0 then 'gravity' when 1 then 'Mechanical_Motion' when 2 then 'unknown' when 3 then 'xyz' end as energy,
  case doc_id % 5 when 0 then 'Crane lifting' when 1 then 'other' when 2 then 'Welding pipe' else '' end as task,
  case doc_id % 11 when 0 then 'cut' when 1 then 'none' end as injury,
  case doc_id % 13 when 0 then 'failed' when 1 then 'Bypassed' when 2 then 'absent' when 3 then 'held' when 4 then 'unknown' end as cond,
  case doc_id % 4 when 0 then 'Permit check' when 1 then 'hard helmet' when 2 then 'Indirect barrier' end as kind,
  doc_id % 17 = 0 as failed"""


def reports(t):
    i = F.col("doc_id")
    pick = lambda n, *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (i % n).cast("int"))
    return t.documents.select(
        "doc_id", "text",
        pick(9, "gravity", "Mechanical_Motion", "unknown", "xyz", None, None, None, None, None).alias("energy"),
        pick(5, "Crane lifting", "other", "Welding pipe", "", "").alias("task"),
        pick(11, "cut", "none", *[None] * 9).alias("injury"),
        pick(13, "failed", "Bypassed", "absent", "held", "unknown", *[None] * 8).alias("cond"),
        pick(4, "Permit check", "hard helmet", "Indirect barrier", None).alias("kind"),
        (i % 17 == 0).alias("failed"),
    )


COLS = r.ReasoningColumns(
    "text", energy_type="energy", job_task="task", injury_type="injury", control_type="kind", control_condition="cond",
    control_failed="failed", book=BOOK,
)


def hit(name):
    return f"regexp_matches(l, '(?i)(?:{RE[name]})')"


HAZARDS = ("h_one", "h_two", "h_three", "h_four")
SPAN = {name: span_sql("l", RE[name]) for name in RE}
ASSESS = f"""base as materialized (select doc_id, text, lower(text) as low, {sparse_sql("text")} as is_sparse,
    {lines_sql("text")} as l, {STRUCT} from documents),
  s0 as (select *, case when coalesce(energy, '') not in ('', 'unknown', 'other') then
        case when contains(replace(lower(energy), '_', ' '), 'gravity') then 'gravity'
        when contains(replace(lower(energy), '_', ' '), 'mechanical motion') then 'mechanical_motion' else 'pressure_stored' end end as he,
      case when contains(lower(task), 'crane') then 'h_lift' when contains(lower(task), 'weld') then 'h_hot' end as ht,
      list_filter([{", ".join(f"case when {hit(h)} then '{h}' end" for h in HAZARDS)}], lambda x: x is not null) as hits,
      {SPAN["interrupted"]} as si, {SPAN["safe"]} as ss, {SPAN["direct"]} as sd, {SPAN["effective"]} as se,
      {SPAN["compromised"]} as sf from base),
  s1 as (select *, coalesce(he, ht, hits[1], 'low_energy_general') as hazard,
      coalesce(he, ht, hits[1]) is not null as energy_present,
      case when he is not null then 'energy_type' when ht is not null then 'job_task' else 'composite_narrative' end as hazard_source,
      case when he is not null then 'Structured energy: ' || replace(lower(energy), '_', ' ')
        when ht is not null then 'Structured job task: ' || lower(task) else
        case hits[1] {" ".join(f"when '{h}' then {SPAN[h]}" for h in HAZARDS)} end end as hazard_span,
      case when coalesce(he, ht, hits[1]) is null then 'low_energy_general' else array_to_string(
        list_concat(case when coalesce(he, ht) is null then []::varchar[] else [coalesce(he, ht)] end, hits), ',') end as all_hazards,
      case when si is not null then 'EXPOSURE_INTERRUPTED'
        when ss is not null then case when contains(lower(ss), 'and the t') then 'NO_WORKER_EXPOSURE' else 'NEARBY_BUT_PROTECTED' end
        when sd is not null then case when contains(lower(sd), 'tion') then 'IN_RELEASE_PATH'
          when contains(lower(sd), 'is') then 'INSIDE_EXCLUSION_ZONE' else 'DIRECT_EXPOSURE' end
        when coalesce(injury, '') not in ('', 'none') then 'DIRECT_EXPOSURE' when is_sparse then 'UNKNOWN'
        else 'POTENTIAL_EXPOSURE' end as exposure_state,
      coalesce(si, ss, sd, case when coalesce(injury, '') not in ('', 'none') then 'Structured injury recorded' end) as exposure_span,
      failed or lower(coalesce(cond, '')) in ('failed', 'bypassed', 'absent') as broken, lower(coalesce(cond, '')) as lc,
      ({hit("ppe")} or contains(lower(coalesce(kind, '')), 'helmet')) and se is null as only_ppe from s0),
  s2 as (select *, case when broken then case lc when 'bypassed' then 'BYPASSED' when 'absent' then 'ABSENT' else 'FAILED' end
      when lc in ('effective', 'held') then 'EFFECTIVE' when se is not null and sf is null then 'EFFECTIVE'
      when sf is not null and se is null then case when contains(lower(sf), 'bypassed') then 'BYPASSED'
        when contains(lower(sf), 'missing') then 'ABSENT' when contains(lower(sf), 'not verified') then 'NOT_VERIFIED' else 'FAILED' end
      when sf is not null then 'FAILED' when exposure_state = 'EXPOSURE_INTERRUPTED' then 'RESTORED_BEFORE_EXPOSURE'
      when {hit("after")} then 'RESTORED_AFTER_EXPOSURE' when {hit("rec")} then 'RECOMMENDATION_ONLY'
      when {hit("plan")} then 'PLANNED_ONLY' else 'UNKNOWN' end as st from s1),
  s3 as (select *, case when only_ppe and st in ('UNKNOWN', 'EFFECTIVE') then 'ABSENT' else st end as st2,
      case when only_ppe and st in ('UNKNOWN', 'EFFECTIVE') then 'Only ordinary protective equipment; no engineered barrier'
        when broken or lc in ('effective', 'held') then 'Structured condition: ' || lc else coalesce(sf, se) end as control_span,
      case when only_ppe then 'PPE' when contains(lower(coalesce(kind, '')), 'permit') then 'PROCEDURAL_CONTROL'
        else 'DIRECT_ENGINEERED_CONTROL' end as control_tier,
      kind is not null and not contains(lower(kind), 'indirect') and not only_ppe as is_direct_control,
      case when contains(low, 'of the to') and contains(low, 'in and') then 'c_one'
        when contains(low, 'que un') and contains(low, 'la les') then 'c_two' end as contradiction from s2),
  s4 as (select *, case when contradiction is not null and st2 = 'EFFECTIVE' then 'FAILED' else st2 end as control_state,
      case when {hit("m_one")} then 'm_one' when {hit("m_two")} then 'm_two' when {hit("m_three")} then 'm_three' end as mechanism
      from s3),
  s5 as (select *, exposure_state in ('NO_WORKER_EXPOSURE', 'NEARBY_BUT_PROTECTED', 'EXPOSURE_INTERRUPTED') as safe,
      exposure_state in ('DIRECT_EXPOSURE', 'IN_RELEASE_PATH', 'INSIDE_EXCLUSION_ZONE') as opened,
      list_filter([case when contradiction is not null then 'resolve_contradiction' end,
        case when energy_present and control_state = 'UNKNOWN' then 'control_state' end,
        case when energy_present and exposure_state = 'UNKNOWN' then 'worker_position' end,
        case when is_sparse then 'complete_narrative' end], lambda x: x is not null) as miss,
      energy_present::int + (hazard_span is not null)::int + (exposure_state <> 'UNKNOWN')::int
        + (control_state <> 'UNKNOWN')::int + (coalesce(energy, '') <> '')::int + (kind is not null)::int as facts from s4),
  s6 as (select *, case when contradiction is not null then 'UNKNOWN' when not energy_present then 'NOT_ESTABLISHED'
        when control_state = 'EFFECTIVE' or safe then 'INTERRUPTED'
        when control_state in ('FAILED', 'BYPASSED', 'ABSENT', 'NOT_VERIFIED') and opened then 'SUPPORTED'
        when is_sparse or exposure_state = 'UNKNOWN' or control_state = 'UNKNOWN' then 'UNKNOWN' else 'PARTIAL' end as consequence_state,
      case when is_sparse or facts <= 1 or contradiction is not null then 'WEAK' when facts >= 4 and len(miss) = 0 then 'STRONG'
        else 'MODERATE' end as evidence_strength,
      case when contradiction is not null then 'CONFLICTING_EVIDENCE'
        when (is_sparse and not (energy_present and control_state in ('FAILED', 'BYPASSED', 'ABSENT', 'EFFECTIVE', 'RESTORED_BEFORE_EXPOSURE')
          and (opened or safe))) or (energy_present and (exposure_state = 'UNKNOWN' or (control_state = 'UNKNOWN' and len(miss) >= 2)))
          then 'INSUFFICIENT_INFORMATION'
        when not energy_present or hazard = 'low_energy_general' then 'LOW_ENERGY'
        when safe or control_state in ('EFFECTIVE', 'RESTORED_BEFORE_EXPOSURE') then 'HIGH_ENERGY_CONTROLLED'
        when control_state in ('FAILED', 'BYPASSED', 'ABSENT', 'NOT_VERIFIED', 'RECOMMENDATION_ONLY', 'PLANNED_ONLY') and opened
          then 'PSIF_PATHWAY_OPEN' else 'INSUFFICIENT_INFORMATION' end as internal_state from s5),
  done as (select *, case internal_state when 'PSIF_PATHWAY_OPEN' then 'PSIF' when 'LOW_ENERGY' then 'NOT_PSIF'
        when 'HIGH_ENERGY_CONTROLLED' then 'NOT_PSIF' else 'INSUFFICIENT_INFORMATION' end as decision,
      case internal_state when 'LOW_ENERGY' then 'PSIF-R-10' when 'HIGH_ENERGY_CONTROLLED' then
        case when exposure_state = 'EXPOSURE_INTERRUPTED' or control_state = 'RESTORED_BEFORE_EXPOSURE' then 'PSIF-R-09' else 'PSIF-R-08' end
        when 'PSIF_PATHWAY_OPEN' then case hazard when 'h_two' then 'R-1' when 'h_lift' then 'R-1' when 'h_one' then 'R-2'
          when 'pressure_stored' then 'R-3' else 'PSIF-R-02' end end as matched_rule from s6)"""


def assessed_query(name, columns, steps=None, sql_columns=None):
    @query(name, f"with {ASSESS} select doc_id, {sql_columns or ', '.join(columns)} from done")
    def _(t):
        out = r.prepare(reports(t), COLS)
        for step in steps or (
            r.detect_hazards, r.exposure_state, r.control_state, r.contradictions, r.consequence, r.evidence_strength, r.decide
        ):
            out = step(out, COLS)
        if "all_hazards" in columns:
            out = out.withColumn("all_hazards", F.array_join("all_hazards", ","))
        if "missing_evidence" in columns:
            out = out.withColumn("missing_evidence", F.array_join("missing_evidence", ","))
        return out.select("doc_id", *columns)


assessed_query("f1_detect_hazards", ["hazard", "energy_present", "hazard_source", "hazard_span", "all_hazards"], (r.detect_hazards,))
assessed_query("f2_exposure_state", ["exposure_state", "exposure_span"], (r.exposure_state,))
assessed_query(
    "f3_control_state", ["control_state", "control_span", "control_tier", "is_direct_control"],
    (r.exposure_state, r.control_state), "st2 as control_state, control_span, control_tier, is_direct_control",
)
assessed_query("f4_contradictions", ["contradiction", "control_state"], (r.exposure_state, r.control_state, r.contradictions))
assessed_query("f5_consequence", ["consequence_state", "mechanism"])
assessed_query(
    "f6_evidence_strength", ["missing_evidence", "facts", "evidence_strength"],
    sql_columns="array_to_string(miss, ',') as missing_evidence, facts, evidence_strength",
)
assessed_query("f7_decide", ["internal_state", "decision", "matched_rule"])


@query(
    "f8_reconcile",
    f"""with {ASSESS}, m as (select *, case when doc_id % 6 > 0 then (doc_id * 37) % 1000 >= 500 end as pred,
        doc_id % 10 = 0 as crit from done),
    g as (select *, case when crit then 'DATA_QUALITY_BLOCKED' when decision = 'INSUFFICIENT_INFORMATION' then 'INSUFFICIENT_EVIDENCE'
      when pred is null or (pred and decision = 'PSIF') or (not pred and decision = 'NOT_PSIF') then 'MODEL_AND_RULE_AGREE'
      when decision = 'PSIF' then 'RULE_EVIDENCE_STRONGER_THAN_MODEL' else 'MODEL_STRONGER_THAN_RULE_EVIDENCE' end as agreement_state from m)
    select doc_id, agreement_state, case agreement_state when 'RULE_EVIDENCE_STRONGER_THAN_MODEL' then 'POTENTIAL_FALSE_NEGATIVE'
      when 'MODEL_STRONGER_THAN_RULE_EVIDENCE' then 'POTENTIAL_FALSE_POSITIVE' end as disagreement_type,
      agreement_state <> 'MODEL_AND_RULE_AGREE' as review_needed,
      case when crit then 'INSUFFICIENT_INFORMATION' else decision end as final_decision from g""",
)
def _(t):
    i = F.col("doc_id")
    out = r.assess(reports(t), COLS).withColumns({
        "predicted": F.when(i % 6 > 0, F.pmod(i * 37, F.lit(1000)) >= 500),
        "quality": F.when(i % 10 == 0, "CRITICAL").otherwise("VALID"),
    })
    return r.reconcile(out, "predicted", "quality").select(
        "doc_id", "agreement_state", "disagreement_type", "review_needed", "final_decision"
    )


@query(
    "f9_rule_agreement",
    """with g as (select l_orderkey, list(distinct l_returnflag || l_linestatus) as rules from lineitem group by 1),
    r as (select l_orderkey, l_orderkey % 3 = 0 as pred, list_has_any(rules, ['RF', 'AF']) as rule_psif from g)
    select l_orderkey, rule_psif, pred = rule_psif as agrees, case when pred <> rule_psif then 'HUMAN_ADJUDICATION_REQUIRED'
      when rule_psif then 'PROCEED_TO_INVESTIGATION' else 'ROUTINE_MONITORING' end as policy from r""",
)
def _(t):
    rules = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("rules"))
    df = rules.withColumn("pred", F.col("l_orderkey") % 3 == 0)
    return rv.rule_agreement(df, "pred", "rules", ("RF", "AF")).select("l_orderkey", "rule_psif", "agrees", "policy")


TRIO = """trio as (select doc_id, ['PSIF', ' not psif', 'Uncertain', 'True', null][doc_id % 5 + 1] as h,
    case when doc_id % 7 < 5 then (doc_id * 37) % 1000 >= 500 end as m, ['0', 'is-psif', 'INSUFFICIENT', null][doc_id % 4 + 1] as r
    from documents),
  n as (select doc_id, case doc_id % 5 when 0 then 'PSIF' when 1 then 'NOT_PSIF' when 3 then 'PSIF' else 'INSUFFICIENT_INFORMATION' end as h,
    case when m then 'PSIF' when not m then 'NOT_PSIF' end as m,
    case doc_id % 4 when 0 then 'NOT_PSIF' when 1 then 'PSIF' when 2 then 'INSUFFICIENT_INFORMATION' end as r from trio),
  rec as (select doc_id, h, m, r, case when h = 'INSUFFICIENT_INFORMATION' then 'HUMAN_INSUFFICIENT' when m is null then 'NOT_APPLICABLE'
      when m = h then 'AGREE' else 'DISAGREE' end as model_vs_human,
    case when h = 'INSUFFICIENT_INFORMATION' then 'HUMAN_INSUFFICIENT' when r is null then 'NOT_APPLICABLE'
      when r = h then 'AGREE' else 'DISAGREE' end as rule_vs_human,
    case when m is null or r is null then 'NOT_APPLICABLE' when m = r then 'AGREE' else 'DISAGREE' end as model_vs_rule,
    case when h = 'INSUFFICIENT_INFORMATION' then 'HUMAN_INSUFFICIENT_INFORMATION'
      when m is not null and r is not null then case when h = m and h = r then 'MODEL_RULE_HUMAN_TRIPLE_AGREEMENT'
        when h = r then 'HUMAN_OVERRIDES_MODEL' when h = m then 'HUMAN_OVERRIDES_RULE' when m <> r then 'THREE_WAY_DISAGREEMENT'
        else 'HUMAN_OVERRIDES_MODEL' end
      when coalesce(h = m, false) or coalesce(h = r, false) or (m is null and r is null) then 'AGREEMENT'
      when m is not null then 'HUMAN_OVERRIDES_MODEL' else 'HUMAN_OVERRIDES_RULE' end as reconciliation from n)"""


@query("f10_reconcile3", f"with {TRIO} select doc_id, model_vs_human, rule_vs_human, model_vs_rule, reconciliation from rec")
def _(t):
    i = F.col("doc_id")
    df = t.documents.select(
        "doc_id", F.get(F.array(*[F.lit(x).cast("string") for x in ("PSIF", " not psif", "Uncertain", "True", None)]), (i % 5).cast("int")).alias("h"),
        F.when(i % 7 < 5, F.pmod(i * 37, F.lit(1000)) >= 500).alias("m"),
        F.get(F.array(*[F.lit(x).cast("string") for x in ("0", "is-psif", "INSUFFICIENT", None)]), (i % 4).cast("int")).alias("r"),
    )
    return rv.reconcile3(df, "h", "m", "r").drop("h", "m", "r")


OPTIONS = list(rv.RUBRIC.values())
ANSWERS = {
    "A_hazard": ("doc_id", ("present", "absent", "unclear", None)), "B_exposure": ("doc_id // 4", ("exposed", "not_exposed", "unclear")),
    "C_control": ("doc_id // 12", ("effective", "failed_or_absent", "degraded", "unclear", "bogus")),
    "D_consequence": ("doc_id // 3", ("credible_sif", "minor_only", "unclear", None)),
    "E_escalation": ("doc_id // 7", ("plausible_escalation", "unlikely_escalation", "unclear")),
    "F_sufficiency": ("doc_id // 5", ("sufficient", "sufficient", "sufficient", "insufficient", "maybe")),
}


def answers(t):
    pairs = []
    for key, (source, values) in ANSWERS.items():
        i = F.floor(F.col("doc_id") / int(source.split("// ")[1])) if "//" in source else F.col("doc_id")
        value = F.get(F.array(*[F.lit(v).cast("string") for v in values]), (i % len(values)).cast("int"))
        pairs += [F.lit(key), value]
    return t.documents.select("doc_id", F.create_map(*pairs).alias("rubric_answers"))


def answer_sql(key):
    source, values = ANSWERS[key]
    listed = ", ".join("null" if v is None else f"'{v}'" for v in values)
    return f"[{listed}][({source}) % {len(values)} + 1]"


RUBRIC_SQL = f"""rub as (select doc_id, {", ".join(f"{answer_sql(k)} as {k[0].lower()}" for k in ANSWERS)} from documents)"""


@query(
    "f11_score_rubric",
    f"""with {RUBRIC_SQL} select doc_id, case when f = 'insufficient' then 'INSUFFICIENT_INFORMATION'
      when a = 'present' and d = 'credible_sif' and (b = 'exposed' or e = 'plausible_escalation')
        and c in ('failed_or_absent', 'degraded', 'unclear') then 'PSIF'
      when coalesce(a, '') = 'absent' or (coalesce(d, '') = 'minor_only' and e = 'unlikely_escalation')
        or (c = 'effective' and b = 'not_exposed' and e = 'unlikely_escalation') then 'NOT_PSIF'
      when coalesce(a, '') = 'unclear' or b = 'unclear' or coalesce(d, '') = 'unclear' then 'INSUFFICIENT_INFORMATION'
      when coalesce(d, '') = 'credible_sif' or e = 'plausible_escalation' then 'PSIF' else 'NOT_PSIF' end as rubric_decision from rub""",
)
def _(t):
    return rv.score_rubric(answers(t)).drop("rubric_answers")


@query(
    "f11_check_rubric",
    f"""with {RUBRIC_SQL} select doc_id, concat_ws(',', case when c = 'bogus' then 'C_control' end,
      case when f = 'maybe' then 'F_sufficiency' end) as rubric_errors from rub""",
)
def _(t):
    return rv.check_rubric(answers(t)).select("doc_id", F.array_join("rubric_errors", ",").alias("rubric_errors"))


CHAIN = ev.ChainPatterns(
    {"e": (r"tion\s+the\s+in", r"que\s+le\s+la", r"er\s+das")}, (r"in\s+the\s+th", r"ent\s+la"), (r"is\s+the\s+of", r"les\s+que"),
    (r"to\s+the", r"que\s+de"), (r"and\s+is", r"el\s+de"), {"m": (r"for\s+of", r"une\s+la")},
)


@query(
    "f12_evidence_chain",
    f"""with base as materialized (select doc_id, {sparse_sql("text")} as sp, {lines_sql("text")} as l, {STRUCT} from documents),
    x as (select *, regexp_matches(l, '(?i)tion the in|que le la|er das') as en, regexp_matches(l, '(?i)in the th|ent la') as ex,
      regexp_matches(l, '(?i)is the of|les que') as ne, regexp_matches(l, '(?i)to the|que de') as fa,
      regexp_matches(l, '(?i)and is|el de') as ef, regexp_matches(l, '(?i)for of|une la') as me,
      ['yes', 'no', null][doc_id % 3 + 1] as we, lower(coalesce(cond, '')) in ('failed', 'bypassed', 'absent') or failed as broken,
      ['serious', 'low', null, 'fatality'][doc_id % 4 + 1] as pot from base),
    s as (select *, case when doc_id % 19 = 0 or coalesce(energy, '') not in ('', 'unknown', 'none', 'other') or en then 'SUPPORTED'
        when sp then 'UNCERTAIN' else 'MISSING' end as hazard_link,
      case when ne then 'MISSING' when coalesce(we, '') = 'yes' or (ex and coalesce(we, '') <> 'no') then 'SUPPORTED'
        when ex then 'MISSING' when sp then 'UNCERTAIN' else 'MISSING' end as exposure_link,
      case when fa and not broken then 'SUPPORTED' when ef then 'MISSING' when broken then 'SUPPORTED' when sp then 'UNCERTAIN'
        else 'MISSING' end as control_link,
      case when me then 'SUPPORTED' when pot in ('serious', 'fatality') then 'PARTIAL' when sp then 'UNCERTAIN' else 'MISSING' end
        as consequence_link from x),
    e as (select *, case when hazard_link = 'SUPPORTED' and consequence_link = 'SUPPORTED' then 'SUPPORTED' when sp then 'UNCERTAIN'
      else 'MISSING' end as escalation_link from s),
    c as (select *, [hazard_link, exposure_link, control_link, consequence_link, escalation_link] as st, concat_ws(',',
      case when sp then 'sparse_narrative' end, case when hazard_link in ('MISSING', 'UNCERTAIN') then 'hazard_missing' end,
      case when hazard_link = 'SUPPORTED' and exposure_link in ('MISSING', 'UNCERTAIN') then 'exposure_missing' end,
      case when control_link in ('MISSING', 'UNCERTAIN') and not sp then 'control_intact' end,
      case when consequence_link in ('MISSING', 'UNCERTAIN') and not sp then 'consequence_missing' end) as br from e)
    select doc_id, hazard_link, exposure_link, control_link, consequence_link, escalation_link,
      len(list_filter(st, lambda v: v = 'SUPPORTED')) as n_supported, len(list_filter(st, lambda v: v = 'PARTIAL')) as n_partial,
      len(list_filter(st, lambda v: v = 'UNCERTAIN')) as n_uncertain, len(list_filter(st, lambda v: v = 'MISSING')) as n_missing,
      case when br = '' and (doc_id * 37) % 1000 >= 500 then 'none_supported_psif' else br end as breaks from c""",
)
def _(t):
    i = F.col("doc_id")
    df = r.prepare(reports(t), COLS)
    pick = lambda n, *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (i % n).cast("int"))
    out = ev.evidence_chain(
        df, CHAIN, F.col("energy"), F.when(i % 19 == 0, "yes"), pick(3, "yes", "no", None), F.lower("cond"), F.col("failed"),
        pick(4, "serious", "low", None, "fatality"), F.pmod(i * 37, F.lit(1000)) >= 500,
    )
    return out.select(
        "doc_id", *[f"{link}_link" for link in ev.LINKS], "n_supported", "n_partial", "n_uncertain", "n_missing",
        F.array_join("breaks", ",").alias("breaks"),
    )


EXPOSURES = ("UNKNOWN", "NO_EXPOSURE", "DIRECT_EXPOSURE", "PROTECTED_POSITION", "INSUFFICIENT_INFORMATION")
CONTROLS = ("UNKNOWN", "EFFECTIVE", "FAILED", "NOT_VERIFIED", "VERIFIED", "INCORRECTLY_ASSUMED", "ABSENT")


def states(t):
    i = F.col("doc_id")
    return t.documents.select(
        "doc_id", F.lower(F.concat_ws(" ", "text", F.get(F.array(*[F.lit(x) for x in ("will be guarded", "hard hat breach", "loto", "")]), (i % 4).cast("int")))).alias("low"),
        F.get(F.array(*[F.lit(x) for x in EXPOSURES]), (i % 5).cast("int")).alias("exposure_state"),
        F.get(F.array(*[F.lit(x) for x in CONTROLS]), (i % 7).cast("int")).alias("control_state"),
        F.get(F.array(*[F.lit(x).cast("string") for x in ("suspended_loads", "working_at_height", "other", "stored_mechanical_energy")]), (F.floor(i / 35) % 4).cast("int")).alias("hazard"),
        F.when(i % 3 == 0, F.array(F.lit("Driving"))).otherwise(F.array().cast("array<string>")).alias("rules"),
    )


STATES = f"""st as (select doc_id, lower(text || ' ' || ['will be guarded', 'hard hat breach', 'loto', ''][doc_id % 4 + 1]) as low,
  {list(EXPOSURES)}[doc_id % 5 + 1] as exposure_state, {list(CONTROLS)}[doc_id % 7 + 1] as control_state,
  ['suspended_loads', 'working_at_height', 'other', 'stored_mechanical_energy'][(doc_id // 35) % 4 + 1] as hazard,
  doc_id % 3 = 0 as has_rule from documents)"""


def any_sql(words):
    return "(" + " or ".join(f"contains(low, '{w}')" for w in words) + ")"


@query(
    "f13_anti_inference",
    f"""with {STATES} select doc_id, concat_ws(',',
      case when doc_id % 2 = 0 and exposure_state in ('UNKNOWN', 'INSUFFICIENT_INFORMATION', 'NO_EXPOSURE', 'PROTECTED_POSITION')
        then 'HAZARD_MENTION_NOT_EXPOSURE' end,
      case when has_rule and not {any_sql(ev.VIOLATION_WORDS)} then 'RULE_MATCH_NOT_VIOLATION' end,
      case when {any_sql(ev.CONTROL_WORDS)} and control_state in ('UNKNOWN', 'NOT_VERIFIED', 'INCORRECTLY_ASSUMED')
        then 'CONTROL_MENTION_NOT_EFFECTIVENESS' end,
      case when {any_sql(ev.PLAN_WORDS)} then 'PLANNED_ACTION_NOT_COMPLETED_CONTROL' end,
      case when {any_sql(ev.PPE_MENTIONS)} then 'PPE_USE_NOT_DIRECT_CONTROL' end,
      case when doc_id % 2 = 0 and control_state in ('EFFECTIVE', 'VERIFIED') then 'HIGH_ENERGY_EQUIPMENT_NOT_PSIF' end) as guards from st""",
)
def _(t):
    out = ev.anti_inference(
        states(t), F.col("low"), F.col("doc_id") % 2 == 0, F.col("exposure_state"), F.col("control_state"), F.col("rules")
    )
    return out.select("doc_id", F.array_join("guards", ",").alias("guards"))


def prompts_sql(terms):
    whens = []
    for h, (_, prompts) in ev.CONTRACTS.items():
        texts = [p for key, p in prompts.items() if terms is None or any(x in key for x in terms)]
        whens.append(f"when '{h}' then {texts if texts else '[]::varchar[]'}")
    return f"(case hazard {' '.join(whens)} else []::varchar[] end)"


@query(
    "f14_completeness",
    f"""with {STATES}, m as (select *, exposure_state in ('UNKNOWN', 'INSUFFICIENT_INFORMATION') as np,
        control_state in ('UNKNOWN', 'NOT_VERIFIED', 'INCORRECTLY_ASSUMED') as nc, hazard <> 'other' as known from st),
    p as (select *, np::int + nc::int as n, list_concat(case when np then {prompts_sql(ev.POSITION_TERMS)} else []::varchar[] end,
      case when nc then {prompts_sql(ev.CONTROL_TERMS)} else []::varchar[] end) as asked from m)
    select doc_id, case when not known then 'UNKNOWN' when n = 0 then 'COMPLETE' when n < 3 then 'PARTIAL' else 'INSUFFICIENT' end
        as completeness,
      case when known then concat_ws(',', case when np then 'worker_position' end, case when nc then 'control_verification' end)
        else '' end as missing_items,
      array_to_string(case when n > 0 and len(asked) = 0 then {prompts_sql(None)} else asked end, '|') as prompts from p""",
)
def _(t):
    out = ev.completeness(states(t))
    return out.select(
        "doc_id", "completeness", F.array_join("missing_items", ",").alias("missing_items"), F.array_join("prompts", "|").alias("prompts")
    )


@query(
    "f15_barrier_linkage",
    f"""with base as materialized (select doc_id, {lines_sql("text")} as l, {STRUCT} from documents),
    x as (select *, {SPAN["effective"]} as se, {SPAN["compromised"]} as sf, lower(coalesce(cond, '')) as lc from base),
    k as (select *, case when failed or lc in ('failed', 'bypassed', 'absent') then 'COMPROMISED' when lc = 'held' then 'CONTROLLED'
      when sf is not null and se is null then 'COMPROMISED' when se is not null and sf is null then 'CONTROLLED'
      when se is not null then 'PARTIALLY_EFFECTIVE' else 'UNKNOWN' end as linkage from x)
    select doc_id, linkage, case when failed or lc in ('failed', 'bypassed', 'absent', 'held') then 'Structured condition: ' || lc
      else coalesce(sf, se) end as linkage_evidence, case when (doc_id * 37) % 1000 >= 500 then case when linkage = 'COMPROMISED' then
      'Primary Barrier Precursor' else 'Operational Hazard Context' end when linkage = 'CONTROLLED' then 'Capacity / Controlled Energy'
      else 'Defended / Low Risk' end as pathway_role from k""",
)
def _(t):
    df = r.prepare(reports(t), COLS)
    out = ev.barrier_linkage(
        df, BOOK.effective, BOOK.compromised, F.col("cond"), F.col("failed"), F.pmod(F.col("doc_id") * 37, F.lit(1000)) >= 500
    )
    return out.select("doc_id", "linkage", "linkage_evidence", "pathway_role")


TEMPLATES = (
    a.ActionTemplate("T1", "Cease the lift", "IMMEDIATE", "HIGH", ("gravity",), ("any",), ("failed", "absent")),
    a.ActionTemplate("T2", "Restore guard", "CORRECTIVE", "MEDIUM", ("any",), ("guard",), ("failed", "unknown"), "RF"),
    a.ActionTemplate("T3", "Stop and secure", "IMMEDIATE", "CRITICAL", ("any",), ("any",), ("failed", "bypassed")),
    a.ActionTemplate("T4", "Escalate to lead", "ESCALATION", "HIGH", (), (), (), when="psif"),
    a.ActionTemplate("T5", "Verify controls", "VERIFICATION", "LOW", (), (), (), when="compromised"),
    a.ActionTemplate("T6", "Document & share", "POSITIVE_LEARNING", "LOW", (), (), (), when="effective"),
)


def action_rows(t):
    flags = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("rules"))
    i = F.col("l_orderkey")
    pick = lambda n, *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (i % n).cast("int"))
    return a.match_actions(
        flags, "l_orderkey", TEMPLATES, pick(3, "gravity", "pressure", None), pick(4, "guard", "valve", "unknown", None),
        pick(5, "failed", "absent", "bypassed", "effective", None), F.col("rules"), i % 2 == 0,
    )


ACTIONS = """o as (select l_orderkey as i, ['gravity', 'pressure', 'unknown'][l_orderkey % 3 + 1] as en,
    ['guard', 'valve', 'unknown', 'unknown'][l_orderkey % 4 + 1] as co,
    ['failed', 'absent', 'bypassed', 'effective', 'unknown'][l_orderkey % 5 + 1] as cd,
    bool_or(l_returnflag || l_linestatus = 'RF') as rf from lineitem group by l_orderkey),
  m as (select i, 'T3' as action_id, 'IMMEDIATE' as action_type, 'CRITICAL' as urgency, 'Stop and secure' as title, 1 as ord from o
      where cd in ('failed', 'bypassed')
    union all select i, 'T1', 'IMMEDIATE', 'HIGH', 'Cease the lift', 2 from o where cd in ('failed', 'absent') and en = 'gravity'
    union all select i, 'T4', 'ESCALATION', 'HIGH', 'Escalate to lead', 3 from o where i % 2 = 0
    union all select i, 'T2', 'CORRECTIVE', 'MEDIUM', 'Restore guard', 4 from o where cd in ('failed', 'unknown')
      and co in ('guard', 'unknown') and rf
    union all select i, 'T5', 'VERIFICATION', 'LOW', 'Verify controls', 5 from o where cd in ('absent', 'failed', 'bypassed', 'unknown')
    union all select i, 'T6', 'POSITIVE_LEARNING', 'LOW', 'Document & share', 6 from o where cd = 'effective'),
  acts as (select i as l_orderkey, row_number() over (partition by i order by ord) as position, action_id, action_type, urgency, title
    from m)"""


@query("f16_match_actions", f"with {ACTIONS} select * from acts")
def _(t):
    return action_rows(t)


@query(
    "f17_merge_actions",
    f"""with {ACTIONS}, k as (select *, action_type || ':' || case when contains(lower(title), 'cease') or contains(lower(title), 'stop')
        then 'STOP_WORK' when contains(lower(title), 'restore') then 'RESTORE_BARRIER' when contains(lower(title), 'verify')
        then 'VERIFY_ENERGY' when contains(lower(title), 'escalat') then 'ESCALATE_SIF' else 'POSITIVE_LEARNING' end as intent,
        'because ' || action_id as evidence, 'h' || (position % 2) as hazard from acts),
    e as (select l_orderkey, intent, string_agg(evidence, ' | ' order by position) as evidence, count(*) as merged,
      arg_min(action_id, position) as action_id, arg_min(title, position) as title, arg_min(action_type, position) as action_type,
      case when bool_or(urgency = 'CRITICAL') then 'CRITICAL' when bool_or(urgency = 'HIGH') then 'HIGH'
        when bool_or(urgency = 'MEDIUM') then 'MEDIUM' else 'LOW' end as urgency from k group by 1, 2),
    h as (select l_orderkey, intent, string_agg(hazard, ', ' order by p) as hazards from (select l_orderkey, intent, hazard,
      min(position) as p from k group by 1, 2, 3) group by 1, 2)
    select e.*, hazards from e join h using (l_orderkey, intent)""",
)
def _(t):
    rows = action_rows(t).withColumns({
        "evidence": F.concat(F.lit("because "), F.col("action_id")),
        "hazard": F.concat(F.lit("h"), (F.col("position") % 2).cast("string")),
    })
    return a.merge_actions(rows, "l_orderkey")


@query(
    "f18_sufficiency",
    f"""with d as (select doc_id, doc_id % 8 > 0 as hp, {sparse_sql("text")} or doc_id % 9 = 0 as sp, doc_id % 6 = 0 as cr,
        doc_id % 5 > 0 as hv, case when doc_id % 7 = 0 then '' when doc_id % 7 = 1 then null else source end as dep from documents),
    w as (select *, case when cr then 'AVAILABLE_WITH_WARNING' else 'AVAILABLE' end as wa from d)
    select doc_id, case when not hp then 'NOT_AVAILABLE' when sp then 'INSUFFICIENT_EVIDENCE' else wa end as psif_status,
      case when sp then 'NOT_RUN' when not hv then 'NOT_READY' else wa end as similarity_status,
      case when coalesce(dep, '') = '' then 'NOT_RUN' else wa end as recurrence_status, wa as rule_status from w""",
)
def _(t):
    from wardline.functions.text import is_sparse

    i = F.col("doc_id")
    out = ev.sufficiency(
        t.documents, i % 8 > 0, is_sparse("text") | (i % 9 == 0), i % 6 == 0, i % 5 > 0,
        F.when(i % 7 == 0, "").when(i % 7 > 1, F.col("source")),
    )
    return out.select("doc_id", "psif_status", "similarity_status", "recurrence_status", "rule_status")


@query(
    "f20_provenance",
    """with d as (select doc_id as i, doc_id % 2 = 0 as syn, doc_id % 13 = 0 as sim, doc_id % 3 > 0 as rev, doc_id % 5 > 0 as rat,
        ['PSIF', 'NOT_PSIF', 'INSUFFICIENT_INFORMATION', null, null, null, null][doc_id % 7 + 1] as dec,
        case when doc_id % 11 < 6 then doc_id % 11 < 3 end as lab,
        ['synthetic', 'human_approved_synthetic', 'real_external', 'real_human', null][(doc_id // 3) % 5 + 1] as src,
        ['1', '0', 'true', null][doc_id % 4 + 1] as raw from documents),
    e as (select *, syn and not sim and rev and rat and (dec is not null or lab is not null) as appr,
      coalesce(src, 'none') as s from d),
    f as (select *, appr or s in ('human_approved_synthetic', 'real_human') as hum from e)
    select i as doc_id, case when appr or (syn and s = 'human_approved_synthetic') then 'HUMAN_APPROVED_SYNTHETIC'
        when not syn and s = 'real_external' then 'REAL_EXTERNAL' when not syn and s = 'real_human' then 'REAL_HUMAN'
        when syn then 'SYNTHETIC' else 'UNKNOWN_UNLABELLED' end as provenance,
      case when sim then 'UNREVIEWED' when dec = 'PSIF' then 'HUMAN_PSIF' when dec = 'NOT_PSIF' then 'HUMAN_NOT_PSIF'
        when dec is not null then 'HUMAN_INSUFFICIENT_INFORMATION' when lab and hum then 'HUMAN_PSIF'
        when not lab and hum then 'HUMAN_NOT_PSIF' else 'UNREVIEWED' end as eligibility,
      case when sim then null when dec = 'PSIF' then true when dec = 'NOT_PSIF' then false when dec is not null then null
        when lab is not null and hum then lab when syn and raw in ('1', 'true') then true when syn and raw = '0' then false end
        as effective_label from f""",
)
def _(t):
    i = F.col("doc_id")
    pick = lambda key, *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values)).cast("int"))
    df = t.documents.select(
        "doc_id", (i % 2 == 0).alias("is_synthetic"), (i % 13 == 0).alias("is_simulated"),
        F.when(i % 3 > 0, "r").alias("reviewer"), F.when(i % 5 > 0, "t").alias("reviewed_at"),
        pick(i, "PSIF", "NOT_PSIF", "INSUFFICIENT_INFORMATION", None, None, None, None).alias("human_decision"),
        F.when(i % 11 < 6, i % 11 < 3).alias("human_label"),
        pick(F.floor(i / 3), "synthetic", "human_approved_synthetic", "real_external", "real_human", None).alias("label_source"),
        pick(i, "1", "0", "true", None).alias("raw_label"),
    )
    return rv.provenance(df).select("doc_id", "provenance", "eligibility", "effective_label")


@query(
    "f21_score_strength",
    f"""with {SCORED}, s as (select *, round((score - 0.5) * 10000)::bigint as gap, (incident_id % 2 = 0)::int + (incident_id % 3 = 0)::int
        + (incident_id % 5 = 0)::int as k from scored)
    select incident_id, case when sparse then 'Weak' when predicted then case when k >= 2 and gap >= 2000 then 'Strong'
        when k >= 1 or gap >= 500 then 'Moderate' else 'Weak' end
        else case when 3 - k >= 2 and -gap >= 2000 then 'Strong' when 3 - k >= 1 and -gap >= 500 then 'Moderate' else 'Weak' end end
        as score_strength,
      concat_ws(',', case when incident_id % 4 < 2 then 'energy' end, case when sparse then 'narrative' end) as missing_information from s""",
)
def _(t):
    i = F.col("incident_id")
    df = t.scored().withColumn("energy", F.when(i % 4 == 0, "unknown").when(i % 4 > 1, "gravity"))
    out = ev.score_strength(
        df, F.col("score"), 0.5, F.col("predicted"), F.col("sparse"), [i % 2 == 0, i % 3 == 0, i % 5 == 0],
        {"energy": "energy", "activity": "activity"},
    )
    return out.select("incident_id", "score_strength", F.array_join("missing_information", ",").alias("missing_information"))


@query(
    "g22_review_analytics",
    f"""with {REVIEWS}, mix as (select count(*) as nr, count(*) filter (decision = 'PSIF') as d1,
        count(*) filter (decision = 'NOT_PSIF') as d2, count(*) filter (decision = 'INSUFFICIENT_INFORMATION') as d3 from revs),
    last as (select incident_id, decision as h from revs qualify row_number() over (partition by incident_id
      order by created_at desc) = 1),
    j as (select doc_id, h, case when doc_id % 7 < 5 then case when (doc_id * 37) % 1000 >= 500 then 'PSIF' else 'NOT_PSIF' end end as m,
      case doc_id % 4 when 0 then 'NOT_PSIF' when 1 then 'PSIF' when 2 then 'INSUFFICIENT_INFORMATION' end as r
      from documents left join last on doc_id = incident_id),
    k as (select *, case when h is null then null when h = 'INSUFFICIENT_INFORMATION' then 'HUMAN_INSUFFICIENT_INFORMATION'
      when m is not null and r is not null then case when h = m and h = r then 'MODEL_RULE_HUMAN_TRIPLE_AGREEMENT'
        when h = r then 'HUMAN_OVERRIDES_MODEL' when h = m then 'HUMAN_OVERRIDES_RULE' when m <> r then 'THREE_WAY_DISAGREEMENT'
        else 'HUMAN_OVERRIDES_MODEL' end
      when coalesce(h = m, false) or coalesce(h = r, false) or (m is null and r is null) then 'AGREEMENT'
      when m is not null then 'HUMAN_OVERRIDES_MODEL' else 'HUMAN_OVERRIDES_RULE' end as st,
      h <> 'INSUFFICIENT_INFORMATION' as firm from j),
    t as (select count(*) as n, count(h) as s, count(*) filter (h is not null and m is not null) as bm,
      count(*) filter (firm and h = m) as am, count(*) filter (h is not null and r is not null) as br,
      count(*) filter (firm and h = r) as ar, count(*) filter (h is not null and m is not null and r is not null) as bt,
      {", ".join(f"count(*) filter (st = '{s}') as {c}" for c, s in (("s0", "MODEL_RULE_HUMAN_TRIPLE_AGREEMENT"), ("s1", "HUMAN_OVERRIDES_MODEL"), ("s2", "HUMAN_OVERRIDES_RULE"), ("s3", "HUMAN_INSUFFICIENT_INFORMATION"), ("s4", "THREE_WAY_DISAGREEMENT"), ("s5", "AGREEMENT")))}
      from k),
    l as (select unnest(['coverage', 'decision:PSIF', 'decision:NOT_PSIF', 'decision:INSUFFICIENT_INFORMATION', 'model_vs_human',
        'rule_vs_human', 'triple_agreement', 'state:MODEL_RULE_HUMAN_TRIPLE_AGREEMENT', 'state:HUMAN_OVERRIDES_MODEL',
        'state:HUMAN_OVERRIDES_RULE', 'state:HUMAN_INSUFFICIENT_INFORMATION', 'state:THREE_WAY_DISAGREEMENT', 'state:AGREEMENT']) as measure,
      unnest([s, d1, d2, d3, am, ar, s0, s0, s1, s2, s3, s4, s5]) as n,
      unnest([n, nr, nr, nr, bm, br, bt, s, s, s, s, s, s]) as base from t, mix)
    select measure, n, base, {pct_sql("n", "base")} as pct from l""",
)
def _(t):
    i = F.col("doc_id")
    df = t.documents.select(
        i.alias("incident_id"), F.when(i % 7 < 5, F.pmod(i * 37, F.lit(1000)) >= 500).alias("predicted"),
        F.when(i % 4 == 0, "NOT_PSIF").when(i % 4 == 1, "PSIF").when(i % 4 == 2, "INSUFFICIENT_INFORMATION").alias("rule_decision"),
    )
    return rv.review_analytics(df, conversation_reviews(t))
