"""Training sets, encoding, fitting and scoring over the documents and labels."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardline.functions.codes import rounded
from wardline.functions.text import is_sparse
from wardline.operators import sampling as s
from wardline.operators import training as tr
from wardline.operators.contributions import boosted_contributions
from wardline.queries.registry import query
from wardline.queries.sqltext import clean_sql, pct_sql, ratio_sql, sparse_sql
from wardline.rules.quality import PLACEHOLDERS


def reports(t):
    i = F.col("doc_id")
    pick = lambda key, *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values)).cast("int"))
    return t.documents.select(
        i.alias("incident_id"), (i % 6 > 0).alias("is_synthetic"), (i % 13 == 0).alias("is_simulated"),
        pick(i, "PSIF", "NOT_PSIF", "INSUFFICIENT_INFORMATION", *[None] * 8).alias("human_decision"),
        F.when(i % 10 < 6, i % 10 < 3).alias("human_label"),
        pick(F.floor(i / 3), "synthetic", "human_approved_synthetic", "real_external", None).alias("label_source"),
        pick(i, "1", "0", "true", "maybe", None).alias("raw_label"),
        pick(F.floor(i / 2), "VALID", "WARNING", "CRITICAL", "VALID", None, "VALID", "VALID").alias("quality_status"),
        F.when(i % 31 == 0, "Test 12").when(i % 37 == 0, " ").otherwise(F.col("text")).alias("narrative"),
    )


REPORTS = f"""rp as (select doc_id as i, doc_id % 6 > 0 as syn, doc_id % 13 = 0 as sim,
    ['PSIF','NOT_PSIF','INSUFFICIENT_INFORMATION',null,null,null,null,null,null,null,null][doc_id % 11 + 1] as dec,
    case when doc_id % 10 < 6 then doc_id % 10 < 3 end as lab,
    ['synthetic','human_approved_synthetic','real_external',null][(doc_id // 3) % 4 + 1] as src,
    ['1','0','true','maybe',null][doc_id % 5 + 1] as raw,
    ['VALID','WARNING','CRITICAL','VALID',null,'VALID','VALID'][(doc_id // 2) % 7 + 1] as q,
    case when doc_id % 31 = 0 then 'Test 12' when doc_id % 37 = 0 then ' ' else text end as tx from documents),
  rg as (select *, coalesce(q <> 'CRITICAL', true) and trim(tx) <> ''
      and lower(trim(tx)) not in ({", ".join(f"'{p}'" for p in PLACEHOLDERS)})
      and not regexp_matches(lower(trim(tx)), '^(?:desc|test|sample|incident)\\s*\\d+$') and regexp_matches(tx, '[\\pL\\pN]') as good,
    syn and not sim as rl, coalesce(dec, '') in ('PSIF', 'NOT_PSIF') as decided, coalesce(dec, '') = 'INSUFFICIENT_INFORMATION' as unsure,
    coalesce(src, '') = 'human_approved_synthetic' and lab is not null as appr from rp),
  rx as (select *, rl and (decided or unsure or appr) as hum, rl and not unsure and not decided as sy,
    case when raw in ('1', 'true') then true when raw = '0' then false when appr then lab end as rawl from rg),
  rs as (select *, case when hum and not unsure and good then 'human_approved_synthetic' when sy and rawl is not null and good
      then 'synthetic' end as ts from rx),
  ro as (select *, case when ts = 'synthetic' then rawl when ts is not null then case when decided then dec = 'PSIF' else lab end end as label,
    case when ts is null then case when hum and unsure then 'INSUFFICIENT_INFORMATION'
      when (hum and not unsure and not good) or (sy and rawl is not null and not good) then 'CRITICAL_QUALITY' when sy then 'UNKNOWN_LABEL'
      end end as ex from rs)"""


@query("t1_training_set", f"with {REPORTS} select i as incident_id, ts as train_source, label from ro where ts is not null")
def _(t):
    return tr.training_set(reports(t), "MIXED_SYNTHETIC").select("incident_id", "train_source", "label")


@query(
    "t1_training_set_limited",
    f"""with {REPORTS} select i as incident_id, ts as train_source from ro where ts is not null
      order by (ts = 'synthetic')::int, i limit 120""",
)
def _(t):
    return tr.training_set(reports(t), "MIXED_SYNTHETIC", 120).select("incident_id", "train_source")


@query(
    "t1_composition",
    f"""with {REPORTS} select count(ts) as eligible, count(*) filter (ts = 'human_approved_synthetic') as human_approved,
      count(*) filter (ts = 'synthetic') as synthetic, count(*) filter (label) as positive, count(*) filter (not label) as negative,
      count(*) filter (ex = 'INSUFFICIENT_INFORMATION') as excluded_insufficient_information,
      count(*) filter (ex = 'CRITICAL_QUALITY') as excluded_critical_quality,
      count(*) filter (ex = 'UNKNOWN_LABEL') as excluded_unknown_label from ro""",
)
def _(t):
    return tr.composition(tr.training_roles(reports(t), "MIXED_SYNTHETIC"))


@query(
    "t2_source_overview",
    f"""with {REPORTS}, b as (select *, rl and not unsure and coalesce(q, '') <> 'CRITICAL' and tx <> '' as ok from rg)
    select 'SYNTHETIC' as source, count(*) filter (ok and raw is not null) as rows, count(*) filter (ok and raw is not null) >= 20
      as eligible from b union all
    select 'HUMAN_APPROVED_SYNTHETIC', count(*) filter (ok and (decided or appr)), count(*) filter (ok and (decided or appr)) >= 20 from b""",
)
def _(t):
    return tr.source_overview(reports(t))


@query(
    "t3_label_audit",
    f"""with {REPORTS}, a as (select count(*) as rows, count(*) filter (rl and dec = 'PSIF') as human_psif,
        count(*) filter (rl and dec = 'NOT_PSIF') as human_not_psif, count(*) filter (not sim and unsure) as human_insufficient,
        count(*) filter (sim) as simulated, count(*) filter (src = 'real_external') as real_external,
        count(*) filter (rl and not unsure) as eligible, count(*) filter (rl and not unsure and raw = '1') as positive,
        count(*) filter (rl and not unsure and raw <> '1') as negative from rg)
    select *, {pct_sql("positive", "eligible", 2)} as positive_pct, {ratio_sql("negative", "positive", 2)} as negative_per_positive,
      case when eligible < 20 then 'TOO_FEW_ROWS' when positive = 0 then 'NO_POSITIVES' when negative = 0 then 'NO_NEGATIVES'
      when positive < 5 then 'TOO_FEW_POSITIVES' end as problem from a""",
)
def _(t):
    return tr.label_audit(reports(t).withColumn("effective_label", F.col("raw_label") == "1"))


def described(documents):
    return documents.withColumns({"long": F.col("n_chars") > 2000, "source": F.when(F.col("doc_id") % 9 > 0, F.col("source"))})


def labelled(t):
    return described(t.documents.join(t.labels, "doc_id")).withColumn("label", F.col("quality").cast("double"))


def inputs(df, categories):
    return tr.encode_inputs(df, ["long"], categories).withColumn("_text", F.coalesce("text", F.lit("")))


def combined(categories):
    """Stages from ``inputs`` to text and structure in one vector."""
    both = VectorAssembler(inputCols=["text_features", "structured"], outputCol="combined")
    return [*tr.text_stages("_text"), tr.encoder(["long"], categories), both]


@query("t4_encode")
def _(t):
    """Flags and one-hot categories with missing and unseen values (no SQL twin: vectors)."""
    rows = tr.encode_inputs(labelled(t), ["long"], ["source", "lang"])
    model = tr.encoder(["long"], ["source", "lang"]).fit(rows.filter("lang <> 'es'"))
    vector = vector_to_array("structured")
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)
    return model.transform(rows).select("doc_id", F.size(vector).alias("width"), total.alias("ones"))


@query(
    "t5_class_weight",
    """with r as (select doc_id, quality, row_number() over (partition by quality order by doc_id) as rn,
        count(*) over (partition by quality) as n from labels),
    tr as (select *, rn > floor(n * 0.15::double + 0.5) as keep from r)
    select quality, count(*) as n, floor(case when quality = 1 then (select count(*) filter (quality = 0)::double /
      count(*) filter (quality = 1) from tr where keep) else 1.0 end * 1e6 + 0.5) / 1e6 as weight from tr where keep group by 1""",
)
def _(t):
    parts = s.stratified_split(t.labels.select("doc_id", "quality"), "doc_id", "quality", 0.15, order=F.col("doc_id"))
    train = tr.class_weight(parts.filter("part = 'train'"), "quality")
    return train.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), rounded(F.max("weight"), 6).alias("weight"))


@query("t6_out_of_fold")
def _(t):
    """Boosted trees with grid search on F2; out-of-fold scores of every row (no SQL twin: model)."""
    rows = inputs(labelled(t), ["source", "lang"])
    ready = Pipeline(stages=combined(["source", "lang"])).fit(rows).transform(rows)
    ready = tr.fold(tr.class_weight(ready.select("doc_id", "label", "combined")), "doc_id")
    _, held_out, _ = tr.train_boosted(ready, "combined")
    return held_out.select("doc_id", "fold", "oof_score")


@query("t9_score")
def _(t):
    """Text and structure to probability, decision, band and sparse flag (no SQL twin: model)."""
    stages = [*combined(["source"]), LogisticRegression(featuresCol="combined")]
    model = Pipeline(stages=stages).fit(inputs(labelled(t), ["source"]))
    return tr.score(inputs(described(t.documents), ["source"]), model, "doc_id", "text")


@query(
    "t10_rollup_contributions",
    """with f as (select l_orderkey as id, case when l_linenumber <= 2 then 'text_' || l_linenumber
        when l_linenumber <= 4 then 'flag=' || l_returnflag else 'status=' || case when l_linestatus = 'F' then '_MISSING_' else 'O' end end as feature,
        ((l_partkey % 21) - 10)::bigint as c, l_linenumber % 2 = 1 as active from lineitem),
    g as (select id, case when feature like 'text\\_%' escape '\\' then 'Narrative content' else split_part(feature, '=', 1) end as field,
      sum(c)::bigint as contribution, max(case when active and contains(feature, '=') then split_part(feature, '=', 2) end) as category,
      bool_or(active or feature like 'text\\_%' escape '\\') as shown from f group by 1, 2),
    k as (select * from g where shown and coalesce(category, '') <> '_MISSING_' and abs(contribution) >= 1)
    select id, field, category, contribution, row_number() over (partition by id order by abs(contribution) desc, field) as rank,
      case when contribution > 0 then 'positive' else 'negative' end as direction from k qualify rank <= 2""",
)
def _(t):
    n = F.col("l_linenumber")
    feature = (
        F.when(n <= 2, F.concat(F.lit("text_"), n.cast("string"))).when(n <= 4, F.concat(F.lit("flag="), F.col("l_returnflag")))
        .otherwise(F.concat(F.lit("status="), F.when(F.col("l_linestatus") == "F", tr.MISSING).otherwise(F.lit("O"))))
    )
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("id"), feature.alias("feature"), (F.col("l_partkey") % 21 - 10).alias("c"), (n % 2 == 1).alias("active")
    )
    return tr.rollup_contributions(rows, "id", "feature", "c", "active", k=2)


@query(
    "t11_snapshot",
    f"""with {REPORTS} select i as incident_id, label::int as target, ts as label_source,
      sha256(i || ':' || label::int || ':' || ts) as digest from ro where ts is not null""",
)
def _(t):
    rows = tr.training_set(reports(t), "MIXED_SYNTHETIC")
    return tr.snapshot(rows, "incident_id", "label", "train_source")


@query(
    "t11_snapshot_hash",
    f"""with {REPORTS}, m as (select label, sha256(i || ':' || label::int || ':' || ts) as d from ro where ts is not null),
    s as (select count(*) as rows, count(*) filter (label) as positive,
      {", ".join(f"sum(('0x' || substr(d, {1 + 15 * k}, 15))::bigint) as s{k}" for k in range(4))} from m)
    select rows, positive, sha256(rows || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) as dataset_hash from s""",
)
def _(t):
    rows = tr.training_set(reports(t), "MIXED_SYNTHETIC")
    return tr.snapshot_hash(tr.snapshot(rows, "incident_id", "label", "train_source"))


@query(
    "t11_hash_tree",
    f"""with {REPORTS}, m as (select sha256(i::varchar) as h, sha256(i || ':' || label::int || ':' || ts) as d from ro where ts is not null),
    l2 as (select substr(h, 1, 2) as bucket, count(*)::bigint as rows, sha256(string_agg(d, '' order by d)) as digest from m group by 1),
    l1 as (select substr(bucket, 1, 1) as bucket, sum(rows)::bigint as rows, sha256(string_agg(digest, '' order by bucket)) as digest from l2 group by 1),
    l0 as (select '' as bucket, sum(rows)::bigint as rows, sha256(string_agg(digest, '' order by bucket)) as digest from l1)
    select 2 as level, * from l2 union all select 1, * from l1 union all select 0, * from l0""",
)
def _(t):
    rows = tr.training_set(reports(t), "MIXED_SYNTHETIC")
    return tr.hash_tree(tr.snapshot(rows, "incident_id", "label", "train_source"), 2)


@query(
    "t11_changed_rows",
    f"""with {REPORTS} select i as incident_id, case i % 200 when 0 then 'removed' when 1 then 'added' else 'changed' end as change
      from ro where ts is not null and i % 200 < 3""",
)
def _(t):
    """Two snapshots, of which the second lacks some rows, has others more and some with the other label."""
    rows = tr.training_set(reports(t), "MIXED_SYNTHETIC")
    i = F.col("incident_id") % 200
    old = tr.snapshot(rows.filter(i != 1), "incident_id", "label", "train_source")
    turned = rows.withColumn("label", F.when(i == 2, ~F.col("label")).otherwise(F.col("label")))
    new = tr.snapshot(turned.filter(i != 0), "incident_id", "label", "train_source")
    return tr.changed_rows(old, new, tr.hash_tree(old), tr.hash_tree(new))


@query("t10_contributions", "select doc_id, true as adds_up from documents")
def _(t):
    """Contributions and bias of boosted trees against the model's raw score, for every document."""
    stages = [tr.encoder(["long"], ["source", "lang"]), VectorAssembler(inputCols=["structured", "n_chars"], outputCol="all")]
    prepare = Pipeline(stages=stages).fit(inputs(labelled(t), ["source", "lang"]))
    model = GBTClassifier(featuresCol="all", labelCol="label", seed=42).fit(prepare.transform(inputs(labelled(t), ["source", "lang"])))
    rows = prepare.transform(inputs(described(t.documents), ["source", "lang"]))
    parts = boosted_contributions(rows, model, "doc_id", "all", [f"x{i}" for i in range(model.numFeatures)])
    sums = parts.groupBy("doc_id").agg((F.sum("contribution") + F.first("bias")).alias("s"))
    raw = model.transform(rows).select("doc_id", vector_to_array("rawPrediction").getItem(1).alias("raw"))
    return raw.join(sums, "doc_id").select("doc_id", (F.abs(F.col("s") - F.col("raw")) < 1e-9).alias("adds_up"))


@query(
    "t12_training_rows",
    f"""select doc_id, md5(case when doc_id % 3 > 0 then source else {clean_sql("text")} end) as narrative, quality as label
      from documents join labels using (doc_id)""",
)
def _(t):
    stored = t.documents.select("doc_id", F.col("source").alias("stored_source"))
    df = labelled(t).join(stored, "doc_id").withColumn("stored", F.when(F.col("doc_id") % 3 > 0, F.col("stored_source")).otherwise(""))
    out = tr.training_rows(df, "quality", ["doc_id"], ["text"], "stored")
    return out.withColumn("narrative", F.md5("narrative"))


@query("l5_baselines")
def _(t):
    """Text, structured and combined classifiers on a random and a group-disjoint split (no SQL twin: models)."""
    df = labelled(t).withColumn("grp", F.concat_ws("_", F.coalesce("source", F.lit("none")), "lang"))
    out = tr.baselines(df, "doc_id", "text", ["source", "lang"], "quality", "grp")
    return out.select("split", "model", "accuracy", "f1", "f2", "roc_auc", "pr_auc")


__all__ = ["is_sparse", "sparse_sql"]
