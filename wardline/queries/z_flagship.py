"""The flagship plan: gate, tag and recurring site x activity x rule groups in a look-back window."""

from pyspark.sql import functions as F

from wardline.functions.text import compose_text, is_sparse
from wardline.operators.crosssite import recurring
from wardline.operators.quality import ReportColumns, quality_gate
from wardline.operators.tagging import tag_rules
from wardline.plans.scale import once
from wardline.queries.c_quality import CHECKED
from wardline.queries.registry import query

RULES = {"Alpha": (r"the",), "Beta": (r"que",), "Gamma": (r"der",)}
EDGE = r"[^\pL\pM\p{Nd}\p{Nl}\p{Pc}]"
HITS = " union all ".join(
    f"select doc_id, '{rule}' as rule from ok where regexp_matches(clean, '(?i)(?:^|{EDGE}){kw}(?:{EDGE}|$)')"
    for rule, (kw,) in RULES.items()
)


@query(
    "flagship_recurring_patterns",
    f"""with {CHECKED}, ok as (select doc_id, source, lang, date '2024-01-01' + (doc_id % 200)::int as day, text as clean from checked
        where coalesce(chk, 'SHORT_NARRATIVE') = 'SHORT_NARRATIVE' and words >= 10),
    h as ({HITS}), j as (select * from h join ok using (doc_id)),
    w as (select * from j where day >= (select date '2024-01-01' + max(doc_id % 200)::int from documents) - 90)
    select source, lang, rule, count(distinct doc_id) as occurrences, min(day) as first_seen, max(day) as last_seen from w
    group by 1, 2, 3 having count(distinct doc_id) >= 3""",
)
def _(t):
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 200).cast("int"))
    docs = t.documents.select("doc_id", "source", "lang", "text", day.alias("day"))
    gated = quality_gate(docs, ReportColumns("text", activity="lang", location="source", incident_date="day"), F.to_date(F.lit("2025-01-01")))
    ready = once(gated.filter("accepted"), narrative=compose_text(["text"])).filter(~is_sparse("narrative"))
    tags = tag_rules(ready, "doc_id", {"narrative": "narrative"}, RULES, contexts=False).select("doc_id", "rule")
    # the narratives stay behind: only ids and short columns meet in the join
    facts = tags.join(docs.select("doc_id", "source", "lang", "day"), "doc_id")
    as_of = docs.agg(F.max("day")).scalar()
    return recurring(facts, ["source", "lang", "rule"], "day", as_of, 90, 3, None, "doc_id", samples=None)
