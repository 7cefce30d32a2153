"""Similarity, sampling and evaluation over embeddings, labels and scored documents."""

from pyspark.sql import functions as F

from wardline.functions.codes import rounded
from wardline.operators import evaluation as v
from wardline.operators import sampling as s
from wardline.operators import similarity as sim
from wardline.plans.scale import work_folder
from wardline.queries.b_filters import SCORED
from wardline.queries.registry import query
from wardline.queries.sqltext import pct_sql, ratio_sql


def decided(t):
    """Labelled documents: toxic ones are insufficient, the rest PSIF by quality."""
    decision = (
        F.when(F.col("toxic") == 1, "INSUFFICIENT_INFORMATION").when(F.col("quality") == 1, "PSIF").otherwise("NOT_PSIF")
    )
    return t.labelled().withColumn("decision", decision)


DECIDED = """dec as (select doc_id as incident_id, ((doc_id * 37) % 1000) / 1000.0::double as score, quality, toxic,
  case when toxic = 1 then 'INSUFFICIENT_INFORMATION' when quality = 1 then 'PSIF' else 'NOT_PSIF' end as decision
  from labels)"""
METRICS = f"""{ratio_sql("tp", "tp + fp")} as precision, {ratio_sql("tp", "tp + fn")} as recall,
  {ratio_sql("2 * tp", "2 * tp + fp + fn")} as f1, {ratio_sql("5 * tp", "5 * tp + 4 * fn + fp")} as f2,
  {ratio_sql("tp + tn", "tp + fp + tn + fn")} as accuracy"""


def confusion_sql(pred, pos, neg):
    return f"""count(*) filter ({pred} and {pos}) as tp, count(*) filter ({pred} and {neg}) as fp,
      count(*) filter (not ({pred}) and {neg}) as tn, count(*) filter (not ({pred}) and {pos}) as fn"""


@query(
    "k1_cosine",
    """with c as (select label, list_transform(generate_series(1, 64), lambda i: 1.0::double / i) as ref from embeddings
        group by 1)
    select vec_id, floor(list_cosine_similarity(embedding::double[], ref) * 1e6 + 0.5) / 1e6 as sim
    from embeddings join c using (label)""",
)
def _(t):
    ref = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.lit(1.0) / i)
    return t.embeddings.select("vec_id", rounded(sim.cosine(F.col("embedding"), ref), 6).alias("sim"))


@query(
    "k2_related",
    """with d as (select vec_id, label, embedding::double[] as e, date '2024-01-01' + (vec_id % 90)::int as day from embeddings),
    t as (select * from d qualify row_number() over (partition by label order by vec_id desc) = 1),
    p as (select t.vec_id as target_id, d.vec_id as related_id, list_cosine_similarity(t.e, d.e) as s
      from t join d on t.label = d.label and t.vec_id <> d.vec_id and d.day >= t.day - 60)
    select target_id, related_id, floor(s * 1e6 + 0.5) / 1e6 as similarity,
      row_number() over (partition by target_id order by s desc, related_id) as rank from p where s >= 0.1
    qualify rank <= 5""",
)
def _(t):
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("vec_id") % 90).cast("int"))
    pool = t.embeddings.withColumn("day", day)
    newest = t.embeddings.groupBy("label").agg(F.max("vec_id").alias("vec_id"))
    targets = pool.join(newest.select("vec_id"), "vec_id", "left_semi")
    out = sim.related(targets, pool, "vec_id", "embedding", 5, 0.1, "day", 60, ["label"])
    return out.withColumn("similarity", rounded(F.col("similarity"), 6))


@query("k3_embed")
def _(t):
    """Hashed TF-IDF vectors of the narratives not embedded yet (no SQL twin: hashing)."""
    done = t.labels.filter("toxic = 1").select(F.col("doc_id"), F.lit("tfidf").alias("model"), F.lit("1").alias("version"))
    out = sim.embed(t.documents, "doc_id", "text", "tfidf", "1", done)
    return out.select("doc_id", "model", "version", F.size("vector").alias("size"), rounded(sim.dot(F.col("vector"), F.col("vector")), 3).alias("length"))


@query("k3_embed_batches", "select doc_id, doc_id % 2 as batch, true as same from documents")
def _(t):
    """Vectors of two batches of one version, the second with other texts to fit on, equal those of the first batch's model."""
    folder, docs = work_folder(t.spark, "vectors"), t.documents.select("doc_id", "text")
    first = sim.embed(docs.filter("doc_id % 2 = 0"), "doc_id", "text", "tfidf", "1", folder=folder)
    second = sim.embed(docs, "doc_id", "text", "tfidf", "1", first, folder=folder)
    whole = sim.hashed_vectors(docs, "text", fitted=sim.kept_vectors(docs, "text", folder, "tfidf", "1")).select("doc_id", F.col("vector").alias("w"))
    both = first.unionByName(second).join(whole, "doc_id")
    return both.select("doc_id", (F.col("doc_id") % 2).alias("batch"), (F.col("vector") == F.col("w")).alias("same"))


def members(t):
    return s.strata(F.col("score"), F.col("sparse"), F.when(F.col("incident_id") % 97 == 0, "yes").otherwise("no"), F.col("site"))


QUOTAS = (("high_score", 25), ("low_score", 25), ("near_threshold", 25), ("moderate_score", 25), ("sparse_narrative", 5),
          ("diverse_categories", 3))


def cohort(t):
    return s.sample_cohort(t.scored(), "incident_id", members(t), QUOTAS, 150, order=F.col("incident_id"))


def cohort_sql():
    pools = {
        "high_score": "score >= 0.5", "low_score": "score < 0.1", "near_threshold": "score >= 0.1 and score <= 0.15",
        "moderate_score": "score >= 0.2 and score < 0.4", "sparse_narrative": "sparse",
        "diverse_categories": "incident_id % 97 = 0",
    }
    parts, before = [], []
    for name, quota in QUOTAS:
        skip = "".join(f" and incident_id not in (select incident_id from {b})" for b in before)
        parts.append(f"{name} as (select incident_id, '{name}' as stratum from scored where {pools[name]}{skip} "
                     f"order by incident_id limit {quota})")
        before.append(name)
    union = " union all ".join(f"select * from {b}" for b in before)
    fill = f"""picked as ({union}), fill as (select incident_id, 'fill' as stratum from scored where incident_id not in
      (select incident_id from picked) order by incident_id limit (select 150 - count(*) from picked)),
      cohort as (select * from (select * from picked union all select * from fill) order by incident_id limit 150)"""
    return f"with {SCORED}, {', '.join(parts)}, {fill}"


@query("k4_sample_cohort", cohort_sql() + " select * from cohort")
def _(t):
    return cohort(t)


@query(
    "k5_sample_report",
    cohort_sql() + """ select count(*) as size, count(*) filter (sparse) as sparse, min(score) as min_score,
      max(score) as max_score, floor(avg(score) * 1e4 + 0.5) / 1e4 as mean_score,
      count(*) filter (score < 0.1) as below_threshold, count(*) filter (score between 0.08 and 0.15) as near_threshold,
      count(*) filter (score >= 0.5) as high_score from cohort join scored using (incident_id)""",
)
def _(t):
    return s.sample_report(cohort(t).join(t.scored(), "incident_id"), "score", "sparse")


@query(
    "k6_kappa",
    f"""with p as (select quality as a, toxic as b from labels), c as (select a, b, count(*) as n from p group by 1, 2),
    m as (select sum(ra * ca)::double as e from (select k, sum(r) as ra, sum(q) as ca from (
      select a as k, n as r, 0 as q from c union all select b, 0, n from c) group by 1)),
    t as (select sum(n)::bigint as pairs, sum(case when a = b then n else 0 end)::bigint as agreed from c),
    k as (select *, (pairs::double * agreed - e) / (pairs::double * pairs - e) as kappa from t, m)
    select pairs, agreed, {ratio_sql("agreed", "pairs")} as raw_agreement, floor(kappa * 1e4 + 0.5) / 1e4 as kappa,
      case when kappa > 0.8 then 'Almost Perfect' when kappa > 0.6 then 'Substantial' when kappa > 0.4 then 'Moderate'
      when kappa > 0.2 then 'Fair' else 'Slight' end as band from k""",
)
def _(t):
    return v.kappa(t.labels, "quality", "toxic")


@query(
    "k7_confusion",
    f"""with {DECIDED}, c as (select count(*) as cohort, count(*) filter (decision = 'INSUFFICIENT_INFORMATION') as insufficient,
      {confusion_sql("score >= 0.1", "decision = 'PSIF'", "decision = 'NOT_PSIF'")} from dec) select *, {METRICS} from c""",
)
def _(t):
    return v.confusion(decided(t), "score", "decision", 0.1)


@query(
    "k8_score_distribution",
    f"""with {DECIDED} select decision as class, count(*) as count, floor(avg(score) * 1e4 + 0.5) / 1e4 as mean,
      floor(stddev_pop(score) * 1e4 + 0.5) / 1e4 as std, min(score) as min, max(score) as max,
      {", ".join(f"floor(quantile_cont(score, {q}) * 1e4 + 0.5) / 1e4 as p{int(q * 100)}" for q in v.QUANTILES)}
      from dec group by 1""",
)
def _(t):
    return v.score_distribution(decided(t), "score", "decision")


CUTS = ", ".join(str(c) for c in v.SWEEP)


@query(
    "k9_threshold_sweep",
    f"""with {DECIDED}, th as (select unnest([{CUTS}])::double as threshold), c as (select threshold,
      {confusion_sql("score >= threshold", "decision = 'PSIF'", "decision = 'NOT_PSIF'")},
      count(*) filter (score >= threshold) as workload, count(*) as n from dec, th group by 1)
    select c.* exclude (n), {pct_sql("workload", "n", 2)} as workload_pct, {METRICS} from c""",
)
def _(t):
    return v.threshold_sweep(decided(t), "score", F.col("decision") == "PSIF", F.col("decision") == "NOT_PSIF")


@query(
    "k10_label_agreement",
    f"""with {DECIDED}, r as (select decision = 'PSIF' as human, case when incident_id % 5 > 0 then incident_id % 3 > 0 end as lab
      from dec where decision <> 'INSUFFICIENT_INFORMATION'),
    a as (select count(*) as evaluable, count(lab) as labelled, count(*) filter (lab = human) as agreed,
      count(*) filter (lab and not human) as overcall, count(*) filter (not lab and human) as undercall from r)
    select *, {ratio_sql("agreed", "labelled")} as agreement from a""",
)
def _(t):
    df = decided(t).withColumn("lab", F.when(F.col("incident_id") % 5 > 0, F.col("incident_id") % 3 > 0))
    return v.label_agreement(df, "lab", "decision")


def conversation_reviews(t):
    """Turns as reviews: the role is the reviewer, the decision follows the text length."""
    size = F.length("text") % 3
    return t.conversations.select(
        F.col("conv_id").alias("incident_id"), F.col("role").alias("reviewer"), F.col("turn").alias("created_at"),
        F.when(size == 0, "PSIF").when(size == 1, "NOT_PSIF").otherwise("INSUFFICIENT_INFORMATION").alias("decision"),
    )


REVIEWS = """revs as (select conv_id as incident_id, role as reviewer, turn as created_at,
  ['PSIF', 'NOT_PSIF', 'INSUFFICIENT_INFORMATION'][length(text) % 3 + 1] as decision from conversations)"""


@query(
    "k11_adjudicate",
    f"""with {REVIEWS}, l as (select * from revs qualify row_number() over (partition by incident_id, reviewer
        order by created_at desc) = 1)
    select a.incident_id, a.decision as decision_1, b.decision as decision_2, a.decision as final_decision,
      case when a.decision = b.decision then 'CONSENSUS' else 'LEAD_DECISION' end as route
    from l a join l b using (incident_id) where a.reviewer = 'user' and b.reviewer = 'assistant'""",
)
def _(t):
    return v.adjudicate(conversation_reviews(t), "user", "assistant")


@query(
    "k12_model_audit",
    f"""with {SCORED}, live as (select site as version, count(*) as predictions, count(*) filter (predicted) as psif,
        count(*) filter (sparse) as sparse from scored group by 1),
    m as (select 'src' || n_nationkey as version, n_nationkey::bigint * 3 as tn, n_nationkey::bigint % 4 as fp,
      n_nationkey::bigint % 5 as fn, n_nationkey::bigint * 2 as tp from nation),
    j as (select m.*, coalesce(predictions, 0) as predictions, coalesce(psif, 0) as psif, coalesce(sparse, 0) as sparse
      from m left join live using (version))
    select *, predictions - psif as not_psif, {pct_sql("psif", "predictions", 2)} as psif_rate,
      {ratio_sql("tp", "tp + fp")} as psif_precision, {ratio_sql("tp", "tp + fn")} as psif_recall,
      {ratio_sql("tn", "tn + fn")} as not_psif_precision, {ratio_sql("tn", "tn + fp")} as not_psif_recall from j""",
)
def _(t):
    k = F.col("n_nationkey").cast("long")
    models = t.nation.select(
        F.concat(F.lit("src"), k.cast("string")).alias("version"), (k * 3).alias("tn"), (k % 4).alias("fp"),
        (k % 5).alias("fn"), (k * 2).alias("tp"),
    )
    return v.model_audit(models, t.scored().withColumnRenamed("site", "version"))


@query(
    "k13_review_audit",
    f"""with {REVIEWS} select count(*) as reviews, count(*) filter (decision = 'PSIF') as psif,
      count(*) filter (decision = 'NOT_PSIF') as not_psif, count(*) filter (decision = 'INSUFFICIENT_INFORMATION') as insufficient,
      bool_and(coalesce(reviewer, '') in ('', 'user', 'assistant')) as all_simulated from revs""",
)
def _(t):
    return v.review_audit(conversation_reviews(t), ["user", "assistant"])


@query(
    "k15_validation_metrics",
    f"""with {SCORED}, h as (select predicted, case when incident_id % 10 = 0 then case incident_id % 30 when 0 then true
        when 10 then false end else quality = 1 end as h from scored join labels on doc_id = incident_id where not sparse),
    c as (select {confusion_sql("predicted", "h", "not h")} from h where h is not null),
    s as (select *, tp + fp + tn + fn as sample_size from c)
    select s.*, {METRICS}, {ratio_sql("tp + tn", "sample_size")} as agreement_rate from s""",
)
def _(t):
    i = F.col("incident_id")
    labels = t.labels.select(F.col("doc_id").alias("incident_id"), "quality")
    df = t.scored().join(labels, "incident_id").withColumns({
        "human_decision": F.when(i % 30 == 0, "PSIF").when(i % 30 == 10, "NOT_PSIF").when(i % 30 == 20, "INSUFFICIENT_INFORMATION"),
        "human_label": F.col("quality") == 1,
    })
    return v.validation_metrics(df)


@query(
    "k16_compare_scores",
    f"""with r as (select ((doc_id * 37) % 1000) >= 500 as a, ((doc_id * 53) % 1000) >= 500 as b, quality = 1 as y from labels),
    l as (select 'active' as model, a as p, y, a <> b as d from r union all select 'candidate', b, y, a <> b from r),
    c as (select model, {confusion_sql("p", "y", "not y")}, count(*) filter (d) as disagreements from l group by 1)
    select *, {METRICS} from c""",
)
def _(t):
    df = t.labels.select(
        t.score(F.col("doc_id")).alias("a"), (F.pmod(F.col("doc_id") * 53, F.lit(1000)) / F.lit(1000.0)).alias("b"),
        (F.col("quality") == 1).alias("y"),
    )
    return v.compare_scores(df, {"active": "a", "candidate": "b"}, "y", 0.5)


@query(
    "t7_best_threshold",
    f"""with {DECIDED}, th as (select unnest([{", ".join(str(c) for c in v.F2_GRID)}])::double as threshold), c as (
      select threshold, {confusion_sql("score >= threshold", "quality = 1", "quality = 0")} from dec, th group by 1),
    m as (select threshold, {METRICS} from c)
    select threshold, f2, precision, recall from m order by f2 desc, threshold limit 1""",
)
def _(t):
    return v.best_threshold(t.labelled(), "score", F.col("quality") == 1, F.col("quality") == 0)


@query(
    "t8_ranking_metrics",
    f"""with {DECIDED}, y as (select score, quality = 1 as y from dec),
    r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from y),
    n as (select count(*) filter (y)::double as p, count(*) filter (not y)::double as n from y),
    auc as (select (sum(rk) filter (y) - p * (p + 1) / 2) / (p * n) as auc from r, n group by p, n),
    s as (select score, count(*) filter (y) as p, count(*) as a from y group by 1),
    cum as (select p, sum(p) over w as tp, sum(a) over w as al from s window w as (order by score desc)),
    ap as (select sum(p * (tp / al)) / sum(p) as ap from cum),
    c as (select {confusion_sql("score >= 0.5", "y", "not y")} from y)
    select c.*, {METRICS}, floor(auc * 1e4 + 0.5) / 1e4 as roc_auc, floor(ap * 1e4 + 0.5) / 1e4 as pr_auc from c, auc, ap""",
)
def _(t):
    return v.ranking_metrics(t.labelled().withColumn("y", F.col("quality") == 1), "score", "y")
