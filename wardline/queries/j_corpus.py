"""Corpus audit over the documents and their labels."""

from pyspark.sql import functions as F

from wardline.operators import corpus as c
from wardline.operators import sampling as s
from wardline.queries.registry import query
from wardline.queries.sqltext import ALNUM, WS, pct_sql, ratio_sql, strip_sql


def labelled(t):
    return t.documents.join(t.labels, "doc_id", "left")


@query(
    "l1_null_rates",
    f"""with d as (select case when doc_id % 7 = 0 then 'None' when doc_id % 11 = 0 then '' else source end as source, lang,
        quality, n_chars from documents left join labels using (doc_id)),
    a as (select count(*) as t, count(*) filter (lower(coalesce(source, '')) in ('', 'none', 'null', 'nan')) as source,
      count(*) filter (lower(coalesce(lang, '')) in ('', 'none', 'null', 'nan')) as lang,
      count(*) filter (quality is null) as quality, count(*) filter (n_chars is null) as n_chars from d),
    l as (unpivot a on source, lang, quality, n_chars into name field value nulls)
    select field, nulls, {ratio_sql("nulls", "t")} as rate from l""",
)
def _(t):
    i = F.col("doc_id")
    df = labelled(t).withColumn("source", F.when(i % 7 == 0, "None").when(i % 11 == 0, "").otherwise(F.col("source")))
    return c.null_rates(df, ["source", "lang", "quality", "n_chars"])


@query(
    "l1_schema_audit",
    f"""with d as (select doc_id // 2 as id, {strip_sql("text")} as t, quality as y from documents left join labels using (doc_id)),
    a as (select count(*) as rows, count(*) filter (t = '') as empty_narratives, count(*) filter (y = 1) as positive,
      count(*) filter (y = 0) as negative, count(*) filter (y is null or y not in (0, 1)) as other_or_missing,
      count(id) - count(distinct id) as duplicate_ids, count(nullif(t, '')) - count(distinct nullif(t, '')) as duplicate_narratives,
      count(distinct nullif(t, '')) as unique_narratives from d)
    select *, {ratio_sql("positive", "positive + negative")} as positive_ratio from a""",
)
def _(t):
    return c.schema_audit(labelled(t).withColumn("id", F.floor(F.col("doc_id") / 2)), "id", "text", "quality")


PHRASES = ("the", "tion is", "que le", "zzzz", "er in the")


@query(
    "l2_boilerplate",
    f"""with a as (select count(*) as t, {", ".join(f"count(*) filter (contains(lower(text), '{p}')) as c{i}" for i, p in enumerate(PHRASES))}
      from documents), l as (select unnest([{", ".join(f"'{p}'" for p in PHRASES)}]) as phrase,
      unnest([{", ".join(f"c{i}" for i in range(len(PHRASES)))}]) as n, t from a)
    select phrase, n, {pct_sql("n", "t", 2)} as prevalence from l""",
)
def _(t):
    return c.boilerplate(t.documents, "text", PHRASES)


SENT = f"""s as (select unnest(regexp_split_to_array(lower(text), '[.!?]')) as x from documents),
  st as (select {strip_sql("x")} as x from s), w as (select regexp_split_to_array(x, '{WS}+') as w from st where length(x) > 5)"""


@query(
    "l2_template_phrases",
    f"""with {SENT}, ph as (
      select 'prefix' as kind, array_to_string(w[1:4], ' ') as phrase from w where len(w) >= 4
      union all select 'suffix', array_to_string(w[len(w)-3:len(w)], ' ') from w where len(w) >= 4
      union all select 'trigram', array_to_string(w[i:i+2], ' ') from (select w, unnest(generate_series(1, len(w) - 2)) as i
        from w where len(w) >= 3)),
    n as (select kind, phrase, count(*) as n from ph group by 1, 2
      having count(*) > case when kind = 'trigram' then 4 else 1 end)
    select *, row_number() over (partition by kind order by n desc, phrase) as rank from n qualify rank <= 10""",
)
def _(t):
    return c.template_phrases(t.documents, "text", 10, 1, 4)


@query(
    "l2_template_severity",
    f"""with {SENT}, o as (select array_to_string(w[1:4], ' ') as p, count(*) as n from w where len(w) >= 4 group by 1),
    r as (select count(*) filter (n > 5) as repeated_openings from o), b as (select count(*) as t,
      count(*) filter (contains(lower(text), 'tion is')) as c1, count(*) filter (contains(lower(text), 'er in the')) as c2
      from documents), k as (select greatest({pct_sql("c1", "t", 2)}, {pct_sql("c2", "t", 2)}) as peak from b)
    select repeated_openings, peak, case when peak > 20 then 'HIGH' when peak > 5 or repeated_openings > 0 then 'MODERATE'
      else 'LOW' end as severity from r, k""",
)
def _(t):
    return c.template_severity(t.documents, "text", ("tion is", "er in the"))


LEAK = f"""d as (select doc_id, quality as y, list_distinct(regexp_extract_all(regexp_replace(lower(text),
    '[^\\pL\\pM\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+', '  ', 'g'), '(?:^| )([a-z]{{3,}})(?: |$)', 1)) as ws
    from documents join labels using (doc_id)),
  w as (select unnest(ws) as word, y from d),
  n as (select word, count(*) filter (y = 1) as positive, count(*) filter (y = 0) as negative, count(*) as n from w group by 1),
  z as (select count(*) filter (quality = 1) as p, count(*) filter (quality = 0) as q from labels join documents using (doc_id)),
  k as (select word, n, positive, negative, {ratio_sql("positive", "n")} as positive_rate, floor(least(
      (positive::double / greatest(1, negative)) / (greatest(1, p - positive)::double / greatest(1, q - negative)), 9999.0)
      * 100 + 0.5) / 100.0 as odds_ratio from n, z where n >= 15 and (positive * 100 > n * 95 or positive * 100 < n * 5))"""


@query("l3_lexical_leakage", f"with {LEAK} select * from k")
def _(t):
    return c.lexical_leakage(labelled(t), "text", "quality")


@query(
    "l3_lexical_leakage_top",
    f"""with {LEAK} select *, row_number() over (order by abs(positive_rate - 0.5) desc, n desc, word) as rank from k
      order by rank limit 15""",
)
def _(t):
    return c.lexical_leakage(labelled(t), "text", "quality", k=15)


@query(
    "l4_stratified_split",
    """with r as (select doc_id, quality, row_number() over (partition by quality order by doc_id) as rn,
        count(*) over (partition by quality) as n from labels)
    select doc_id, quality, case when rn <= floor(n * 0.2::double + 0.5) then 'test' else 'train' end as part from r""",
)
def _(t):
    return s.stratified_split(
        t.labels.select("doc_id", "quality"), "doc_id", "quality", 0.2, order=F.col("doc_id")
    ).select("doc_id", "quality", "part")


@query(
    "l4_group_overlap",
    "select 0::bigint as overlap, count(distinct source || '_' || lang) as groups from documents",
)
def _(t):
    df = t.documents.select("doc_id", F.concat_ws("_", "source", "lang").alias("grp"))
    return s.group_overlap(s.split(df, "doc_id", 0.2, group="grp"), "grp")


@query(
    "l6_hard_negatives",
    f"""with a as (select count(*) as negatives, count(*) filter ((contains(lower(text), 'tion') or contains(lower(text), 'que'))
        and (contains(lower(text), 'th') or contains(lower(text), 'la'))) as hard_negatives
      from documents join labels using (doc_id) where quality = 0)
    select *, {ratio_sql("hard_negatives", "negatives")} as share, case when {ratio_sql("hard_negatives", "negatives")} >= 0.15
      then 'ADEQUATE' else 'SPARSE' end as verdict from a""",
)
def _(t):
    return c.hard_negatives(labelled(t), "text", "quality", ("tion", "que"), ("th", "la"))


PAIRS = """p as (select conv_id, max(s) filter (role = 'user') as score_a, max(s) filter (role = 'assistant') as score_b from
    (select conv_id, role, (length(text) % 100) / 100.0::double as s from conversations) group by 1),
  t as (select conv_id, score_a, score_b, floor((score_a - score_b) * 10000 + 0.5) / 10000.0 as delta from p
    where score_a is not null and score_b is not null), u as (select *, delta > 0.05 as passed from t)"""


def pairs(t):
    rows = t.conversations.select("conv_id", "role", ((F.length("text") % 100) / F.lit(100.0)).alias("score"))
    return c.paired_test(rows, "conv_id", "role", "score", "user", "assistant")


@query("l7_paired_test", f"with {PAIRS} select * from u")
def _(t):
    return pairs(t)


@query(
    "l7_paired_summary",
    f"""with {PAIRS}, a as (select count(*) as pairs, count(*) filter (passed) as correct from u)
    select *, {ratio_sql("correct", "pairs")} as accuracy, case when {ratio_sql("correct", "pairs")} >= 0.8 then 'STRONG'
      when {ratio_sql("correct", "pairs")} >= 0.6 then 'MODERATE' else 'POOR' end as validity from a""",
)
def _(t):
    return c.paired_summary(pairs(t))


@query(
    "l8_edge_pass_rate",
    f"""with a as (select count(*) as cases, count(*) filter ((doc_id * 37) % 1000 < 500) as passed from documents)
    select *, {ratio_sql("passed", "cases")} as pass_rate, case when passed = cases then 'ROBUST'
      when {ratio_sql("passed", "cases")} >= 0.8 then 'MODERATE' else 'VULNERABLE' end as verdict from a""",
)
def _(t):
    return c.edge_pass_rate(t.predictions(), "score")


@query("l10_sample_n")
def _(t):
    """Seeded sample by hash of the id (no SQL twin: hash function)."""
    return s.sample_n(t.documents.select("doc_id", "source"), 100, "doc_id")


__all__ = ["ALNUM"]
