"""Portfolio reports over documents, orders and line items."""

from pyspark.sql import functions as F

from wardline.functions.codes import risk_band
from wardline.operators import bitmaps as b
from wardline.operators import portfolio as p
from wardline.plans.scale import work_folder
from wardline.queries.b_filters import SCORED
from wardline.queries.d_patterns import listed
from wardline.queries.registry import query
from wardline.queries.sqltext import pct_sql, ratio_sql

RULES = ["A-F", "N-F", "N-O", "R-F", "Z-Z"]


def reviewed(t):
    """Documents with predictions (none for every 23rd) and human decisions from the labels."""
    i = F.col("incident_id")
    df = t.scored().join(t.labels.withColumnRenamed("doc_id", "incident_id"), "incident_id", "left")
    has = i % 23 > 0
    return df.select(
        "incident_id", "site", "activity", "sparse", F.when(has, F.col("predicted")).alias("predicted"), "score",
        F.when(has, risk_band(F.col("score"))).alias("risk_level"),
        (i % 5 == 0).alias("adjudicated"),
        F.when(i % 15 == 0, "PSIF").when(i % 15 == 5, "NOT_PSIF").when(i % 15 == 10, "INSUFFICIENT_INFORMATION")
        .alias("human_decision"),
        F.when(i % 5 > 0, F.col("quality") == 1).alias("human_label"),
    )


REVIEWED = f"""{SCORED}, rev as (select s.incident_id, site, activity, sparse, score,
    case when s.incident_id % 23 > 0 then predicted end as predicted,
    s.incident_id % 23 > 0 and score >= 0.5 as high, s.incident_id % 5 = 0 as adjudicated,
    case s.incident_id % 15 when 0 then 'PSIF' when 5 then 'NOT_PSIF' when 10 then 'INSUFFICIENT_INFORMATION' end as dec,
    case when s.incident_id % 5 > 0 then quality = 1 end as lab
  from scored s left join labels on doc_id = s.incident_id)"""


def summary_sql(reviewed_condition):
    return f"""count(*) as incidents, count(predicted) as predictions,
  count(*) filter (predicted is not null and sparse) as insufficient,
  count(*) filter (predicted is not null and not sparse) as eligible, count(*) filter (predicted and not sparse) as psif,
  count(*) filter (not predicted and not sparse) as not_psif, count(*) filter (high and not sparse) as high_risk,
  count(*) filter ({reviewed_condition}) as reviewed,
  count(*) filter (dec = 'PSIF' or (dec is null and lab)) as human_psif,
  count(*) filter (dec = 'NOT_PSIF' or (dec is null and not lab)) as human_not_psif,
  count(*) filter (dec = 'INSUFFICIENT_INFORMATION') as human_insufficient"""


RATES = f"""*, {ratio_sql("psif", "eligible")} as psif_rate, {ratio_sql("predictions", "incidents")} as coverage_rate,
  {ratio_sql("reviewed", "incidents")} as reviewed_rate"""


@query(
    "g2_summary",
    f"""with {REVIEWED}, a as (select {summary_sql("adjudicated or lab is not null")} from rev)
      select {RATES} from a""",
)
def _(t):
    return p.summary(reviewed(t))


@query(
    "g2_summary_by_site",
    f"""with {REVIEWED}, a as (select site, {summary_sql("adjudicated or lab is not null")} from rev group by 1)
      select {RATES} from a""",
)
def _(t):
    return p.summary(reviewed(t), ["site"])


@query(
    "g3_workspace_summary",
    f"""with {REVIEWED}, a as (select {summary_sql("adjudicated or lab is not null or incident_id in (select conv_id from conversations)")}
      from rev where site in ('src1', 'src2', 'src3', 'src4')) select {RATES} from a""",
)
def _(t):
    reviews = t.conversations.select(F.col("conv_id").alias("incident_id"), "role")
    return p.workspace_summary(reviewed(t), reviews, F.col("site").isin("src1", "src2", "src3", "src4"))


@query(
    "g4_score_profile",
    f"""with {REVIEWED}, a as (select site, count(*) filter (e and score < 0.2) as low,
      count(*) filter (e and score >= 0.2 and score < 0.5) as medium,
      count(*) filter (e and score >= 0.5 and score < 0.75) as high, count(*) filter (e and score >= 0.75) as critical,
      sum(case when e then (score * 1000)::bigint end)::bigint as s, count(*) filter (e) as n,
      count(*) filter (adjudicated) as reviewed, count(*) filter (not adjudicated) as unreviewed
      from (select *, predicted is not null and not sparse as e from rev) group by 1)
    select site, low, medium, high, critical, {ratio_sql("s", "n * 1000", 3)} as average_score, reviewed, unreviewed from a""",
)
def _(t):
    out = p.score_profile(reviewed(t).withColumn("reviewed", F.col("adjudicated")), ["site"])
    return out.withColumn("average_score", F.floor(F.col("average_score") * 1000 + 0.5 + 1e-9) / F.lit(1000.0))


BASE = """base as (select o_orderkey as incident_id, case when o_orderkey % 17 = 0 then '' else n_name end as site,
    r_name as region, c_mktsegment as department, o_orderpriority as activity, o_orderstatus as hazard,
    case o_orderkey % 4 when 0 then 'failed' when 1 then 'effective' when 2 then 'unknown' end as control,
    o_orderdate::date as event_date, o_orderkey % 7 = 0 as predicted, o_orderkey % 11 = 0 as sparse
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey),
  tags as (select distinct l_orderkey as incident_id, l_returnflag || '-' || l_linestatus as rule from lineitem
    where l_linenumber > 2),
  pairs as (select t.rule, b.* from tags t join base b using (incident_id))"""


def base(t):
    r = F.col("incident_id") % 4
    return t.dated().withColumns({
        "site": F.when(F.col("incident_id") % 17 == 0, "").otherwise(F.col("site")),
        "control": F.when(r == 0, "failed").when(r == 1, "effective").when(r == 2, "unknown"),
    })


def tags(t):
    return t.lineitem.filter(F.col("l_linenumber") > 2).select(
        F.col("l_orderkey").alias("incident_id"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("rule")
    )


RULE_COUNTS = """counts as (select rule, count(*) as matched, count(*) filter (predicted and not sparse) as psif_linked,
  count(distinct nullif(site, '')) as affected_sites from pairs group by 1)"""
LISTED = "listed(rule) as (values " + ", ".join(f"('{r}')" for r in RULES) + ")"
LINKAGE = pct_sql("psif_linked", "matched") + " as linkage_rate"


@query(
    "g5_rule_metrics",
    f"""with {BASE}, {RULE_COUNTS}, {LISTED}, u as (
      select rule, coalesce(matched, 0) as matched, coalesce(psif_linked, 0) as psif_linked,
        coalesce(affected_sites, 0) as affected_sites from listed left join counts using (rule)
      union all select 'No Rule Matched', count(*), count(*) filter (predicted and not sparse),
        count(distinct nullif(site, '')) from base where incident_id not in (select incident_id from tags))
    select *, {LINKAGE} from u""",
)
def _(t):
    return p.rule_metrics(tags(t), base(t), RULES)


@query(
    "g6_barrier_portfolio",
    f"""with {BASE}, {RULE_COUNTS}, {LISTED}, u as (
      select rule, coalesce(matched, 0) as matched, coalesce(psif_linked, 0) as psif_linked,
        coalesce(affected_sites, 0) as affected_sites from listed left join counts using (rule)
      union all select 'ALL', count(*), count(*) filter (predicted and not sparse),
        count(distinct nullif(site, '')) from base where incident_id in (select incident_id from tags))
    select *, {LINKAGE} from u""",
)
def _(t):
    return p.barrier_portfolio(tags(t), base(t), RULES)


def best_sql(column, name, where="true"):
    return f"""{name} as (select rule, {column} as {name} from pairs where {column} <> '' and {where} group by 1, 2
      qualify row_number() over (partition by rule order by count(*) desc, {column}) = 1)"""


@query(
    "g7_portfolio_cards",
    f"""with {BASE}, {RULE_COUNTS}, {best_sql("activity", "top_activity")}, {best_sql("site", "top_location")},
      {best_sql("control", "dominant_control", "control <> 'unknown'")},
      smp as (select rule, string_agg(incident_id, ',' order by event_date desc, incident_id) as samples from
        (select rule, incident_id, event_date from pairs
         qualify row_number() over (partition by rule order by event_date desc, incident_id) <= 4) group by 1)
    select c.*, {LINKAGE}, top_activity, top_location, dominant_control, samples from counts c
      left join top_activity using (rule) left join top_location using (rule) left join dominant_control using (rule)
      left join smp using (rule)""",
)
def _(t):
    return p.portfolio_cards(tags(t), base(t)).withColumn(
        "samples", F.array_join(F.col("samples").cast("array<string>"), ",")
    )


@query(
    "g8_barrier_detail",
    f"""with {BASE} select incident_id, site, activity, predicted, row_number() over (order by incident_id desc) as rank
      from pairs where rule = 'R-F' order by incident_id desc limit 10 offset 10""",
)
def _(t):
    return p.barrier_detail(tags(t), base(t), "R-F", page=2, columns=["site", "activity", "predicted"])


@query("j2_inner_conditional", f"with {BASE}, {RULE_COUNTS} select rule, matched, psif_linked from counts")
def _(t):
    return p.rule_metrics(tags(t), base(t)).filter(F.col("rule") != p.NO_RULE_ROW).select("rule", "matched", "psif_linked")


@query(
    "j5_dimension_completion",
    f"""with {BASE}, {RULE_COUNTS}, {LISTED} select rule, coalesce(matched, 0) as matched from listed
      left join counts using (rule)""",
)
def _(t):
    out = p.barrier_portfolio(tags(t), base(t), RULES)
    return out.filter(F.col("rule") != "ALL").select("rule", "matched")


@query(
    "g13_trend",
    f"""with {BASE} select strftime(event_date, '%Y-%m') as month, count(*) as incidents,
      count(*) filter (not sparse) as eligible, count(*) filter (predicted and not sparse) as psif
      from base where incident_id % 10 > 0 group by 1""",
)
def _(t):
    df = base(t).withColumn("event_date", F.when(F.col("incident_id") % 10 > 0, F.col("event_date")))
    return p.trend(df, "event_date")


@query(
    "g21_breakdown_top",
    f"""with {BASE} select department, count(*) as incidents, row_number() over (order by count(*) desc, department) as rank
      from base group by 1 order by rank limit 3""",
)
def _(t):
    return p.breakdown(base(t), "department", 3)


@query("g21_breakdown", f"with {BASE} select rule, count(*) as incidents from tags group by 1")
def _(t):
    return p.breakdown(tags(t).distinct(), "rule")


@query(
    "g23_batch_status",
    """select lang as dataset, count(*) as incidents, count(*) filter (d.p and not d.s) as psif,
      count(*) filter (not d.p and not d.s) as non_psif, count(*) filter (d.s) as insufficient,
      count(*) filter (doc_id % 5 < 3) as accepted, count(*) filter (doc_id % 5 = 3) as warnings,
      count(*) filter (doc_id % 5 = 4) as rejected
      from (select *, (doc_id * 37) % 1000 >= 500 as p, n_chars < 200 as s from documents) d group by 1""",
)
def _(t):
    i = F.col("doc_id")
    df = t.documents.select(
        F.col("lang").alias("dataset"), (F.pmod(i * 37, F.lit(1000)) >= 500).alias("predicted"),
        (F.col("n_chars") < 200).alias("sparse"),
        F.when(i % 5 < 3, "VALID").when(i % 5 == 3, "WARNING").otherwise("CRITICAL").alias("quality_status"),
    )
    return p.batch_status(df, "dataset")


@query(
    "g24_throughput",
    f"""with r as (select o_orderpriority as kind, o_custkey as rows, o_orderkey % 90 as seconds from orders
        where o_orderkey % 90 > 0 and o_custkey >= 1
        qualify row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey desc) <= 50),
    g as (select kind, count(*) as runs, sum(rows)::bigint as rows, sum(seconds)::bigint as seconds from r group by 1)
    select *, {ratio_sql("rows", "seconds", 2)} as rows_per_second from g""",
)
def _(t):
    runs = t.orders.select(
        F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("rows"),
        (F.col("o_orderkey") % 90).alias("seconds"), F.col("o_orderdate").alias("finished"), F.col("o_orderkey").alias("run"),
    )
    return p.throughput(runs, "kind", "rows", "seconds", "finished", "run")


@query(
    "g25_list_patterns",
    """with w as (select doc_id, lang, list_distinct(regexp_extract_all(text[1:], '[a-z]{9,}')) as words,
        list_distinct(regexp_extract_all(text, '[A-Z][a-z]{5,}')) as names from documents),
    items as (select 'word' as kind, unnest(words) as item from w union all select 'name', unnest(names) from w
      union all select 'activity', lang from w
      union all select 'activity_pair', lang || ' -> ' || unnest(words) from w),
    n as (select kind, item, count(*) as n from items group by 1, 2)
    select *, row_number() over (partition by kind order by n desc, item) as rank from n
    qualify row_number() over (partition by kind order by n desc, item) <= 5""",
)
def _(t):
    df = t.documents.select(
        "lang", F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{9,}"), 0)).alias("words"),
        F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), 0)).alias("names"),
    )
    return p.list_patterns(df, {"word": "words", "name": "names"}, "lang", "word")


@query(
    "g26_linkage_shares",
    f"""with {BASE}, {RULE_COUNTS}, s as (select rule, matched, psif_linked from counts), tot as (
      select sum(matched) as m, sum(psif_linked) as l from s)
    select s.*, {pct_sql("psif_linked", "matched", 2)} as linkage, {pct_sql("psif_linked", "l", 2)} as linked_share,
      {pct_sql("matched", "m", 2)} as matched_share from s, tot""",
)
def _(t):
    counts = p.rule_metrics(tags(t), base(t)).filter(F.col("rule") != p.NO_RULE_ROW)
    return p.linkage_shares(counts.select("rule", "matched", "psif_linked"))


@query(
    "w2_top_k_per_group",
    f"""with {BASE}, r as (select site, activity, count(*) as n, row_number() over (partition by site
        order by count(*) desc, activity) as rn from base where activity <> '' group by 1, 2)
    select site, string_agg(activity || '=' || n, ';' order by rn) as top from r where rn <= 3 group by 1""",
)
def _(t):
    return p.top_items(base(t), ["site"], "activity", 3).withColumn("top", listed("top"))


FLAGS = "l_returnflag || '-' || l_linestatus as rule, date_trunc('month', l_shipdate)::date as month"


@query(
    "g6_distinct_rollup",
    f"""with x as (select {FLAGS}, l_orderkey as id from lineitem)
      select rule, month, count(distinct id)::bigint as incidents from x group by grouping sets ((rule, month), (rule), (month), ())""",
)
def _(t):
    """Distinct orders per rule and month, per rule, per month and in all, out of one table of bitmaps."""
    rows = t.lineitem.select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("rule"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month"), "l_orderkey"
    )
    path = work_folder(t.spark, "cube")
    b.distinct_cube(rows, ["rule", "month"], "l_orderkey").write.parquet(path)
    cube = t.spark.read.parquet(path)
    parts = [b.distinct_totals(cube, keys) for keys in (["rule", "month"], ["rule"], ["month"], [])]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
