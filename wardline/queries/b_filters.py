"""Filters and predicates."""

import datetime as dt

from pyspark.sql import functions as F

from wardline.functions.codes import risk_band
from wardline.operators import filters as f
from wardline.queries.registry import query
from wardline.queries.sqltext import sparse_sql

SCORED = f"""scored as (select doc_id as incident_id, text, source as site, lang as activity,
  ((doc_id * 37) % 1000) / 1000.0::double as score, ((doc_id * 37) % 1000) >= 500 as predicted,
  {sparse_sql('text')} as sparse from documents)"""


def doc_tags(t):
    """Events as tags of documents: rule is the event type."""
    return t.events.select(F.col("user_id").alias("incident_id"), F.col("event_type").alias("rule"))


@query(
    "c1_filter_incidents",
    """select doc_id as incident_id, source as site from documents where lang = 'en'
      and (contains(lower(text), 'tion') or contains(lower(source), 'tion'))
      and doc_id in (select user_id from events where event_type = 'error')""",
)
def _(t):
    return f.filter_incidents(
        t.incidents(), text="TION", text_cols=["narrative", "site"], equals={"activity": "en"}, rule="Error",
        tags=doc_tags(t),
    ).select("incident_id", "site")


@query(
    "c2_filter_incidents_risk",
    f"""with {SCORED} select incident_id, site, score from scored where score >= 0.75 and activity = 'en'
      and incident_id in (select user_id from events where event_type = 'view')""",
)
def _(t):
    preds = t.predictions().withColumn("risk_level", risk_band(F.col("score")))
    return f.filter_incidents(
        t.incidents(), equals={"activity": "en"}, rule="view", tags=doc_tags(t), predictions=preds, risk="critical",
        newest=["score"],
    ).select("incident_id", "site", "score")


def queue_tables(t):
    docs = t.documents
    base = docs.select(
        F.col("doc_id").alias("incident_id"), F.col("source").alias("department"), F.col("lang").alias("location"),
        F.col("text").alias("narrative"),
        F.when(F.col("doc_id") % 3 == 0, "ADJUDICATED").otherwise("UNREVIEWED").alias("adjudication_status"),
        F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "PSIF").otherwise("NOT_PSIF"))
        .alias("human_decision"),
        F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 365).cast("int")).alias("incident_date"),
    )
    preds = t.predictions().withColumn(
        "evidence_strength",
        F.when(F.col("incident_id") % 4 == 0, "Weak").when(F.col("incident_id") % 4 == 1, "Moderate").otherwise("Strong"),
    )
    quality = docs.select(
        F.col("doc_id").alias("incident_id"),
        F.when(F.col("n_chars") > 2000, "WARNING").otherwise("VALID").alias("quality_status"),
    )
    reviews = t.labels.select(
        F.col("doc_id").alias("incident_id"),
        F.when(F.col("quality") != F.col("toxic"), "THREE_WAY_DISAGREEMENT").otherwise("ALL_AGREE").alias("agreement_state"),
    )
    return base, preds, quality, reviews, doc_tags(t)


@query(
    "c3_review_queue",
    f"""with {SCORED} select s.incident_id, s.site as department from scored s join documents d on d.doc_id = s.incident_id
      where s.incident_id % 3 <> 0 and (contains(lower(site), 'src1') or contains(lower(activity), 'src1'))
      and s.incident_id % 365 between 31 and 300 and contains(lower(s.text), 'the') and predicted and not sparse
      and n_chars > 2000 and s.incident_id % 4 > 1""",
)
def _(t):
    return f.review_queue(
        *queue_tables(t), review_state="pending", quality_warning=True, sparse=False, psif=True, strength="strong",
        site="SRC1", date_from=dt.date(2024, 2, 1), date_to=dt.date(2024, 10, 27), activity="the",
        activity_cols=["narrative"],
    ).select("incident_id", "department")


@query(
    "c3_review_queue_agreement",
    """select doc_id as incident_id, source as department from documents
      where doc_id % 3 = 0 and doc_id in (select doc_id from labels where quality <> toxic)""",
)
def _(t):
    return f.review_queue(
        *queue_tables(t), review_state="reviewed", agreement="THREE_WAY_DISAGREEMENT"
    ).select("incident_id", "department")


def event_observations(t):
    """Events as long observations: three dimensions per user."""
    state = (
        F.when(F.col("event_id") % 10 == 0, "INSUFFICIENT_INFORMATION").when(F.col("event_id") % 2 == 0, "PSIF")
        .otherwise("NOT_PSIF")
    )
    dimension = F.element_at(
        F.array(F.lit("activity"), F.lit("location"), F.lit("barrier")), (F.col("event_id") % 3 + 1).cast("int")
    )
    control = F.element_at(
        F.array(F.lit("ABSENT"), F.lit("EFFECTIVE"), F.lit("FAILED"), F.lit("UNKNOWN")), (F.col("user_id") % 4 + 1).cast("int")
    )
    return t.events.select(
        "event_id", F.col("user_id").alias("incident_id"), state.alias("psif_state"), dimension.alias("dimension"),
        F.col("event_type").alias("value"), control.alias("control_state"),
    )


OBS = """obs as (select event_id, user_id as incident_id,
  case when event_id % 10 = 0 then 'INSUFFICIENT_INFORMATION' when event_id % 2 = 0 then 'PSIF' else 'NOT_PSIF' end
  as psif_state, ['activity','location','barrier'][event_id % 3 + 1] as dimension, event_type as value,
  ['ABSENT','EFFECTIVE','FAILED','UNKNOWN'][user_id % 4 + 1] as control_state from events)"""


@query(
    "c4_filter_observations",
    f"""with {OBS}, p as (select * from obs where psif_state = 'PSIF' and contains(value, 'c')),
    a as (select * from p where incident_id in (select incident_id from p where dimension = 'activity'
      and contains(value, 'cl')))
    select event_id, incident_id from a where incident_id in (select incident_id from a where dimension = 'barrier'
      and control_state in ('ABSENT','FAILED') and contains(value, 'click'))""",
)
def _(t):
    return f.filter_observations(
        event_observations(t), psif="psif", activity="CL", barrier="Click", text="C", text_cols=["value"]
    ).select("event_id", "incident_id")


@query(
    "c5_in_window",
    """select o_orderkey from orders, (select max(o_orderdate)::date as d from orders) m
      where coalesce(case when o_orderkey % 4 > 0 then o_orderdate::date end, (o_orderdate + interval 40 day)::date)
        >= m.d - 90""",
)
def _(t):
    rows = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.to_date("o_orderdate")).alias("event_date"),
        F.date_add(F.to_date("o_orderdate"), 40).alias("created"), "o_orderdate",
    )
    as_of = f.latest_day(t.orders, "o_orderdate")
    return rows.filter(f.in_window("event_date", "created", as_of, 90)).select("o_orderkey")


@query(
    "c6_non_blank",
    """select l_returnflag, count(*) as n from lineitem
      where nullif(case when l_linenumber > 3 then '' else l_linestatus end, '') is not null
        and case when l_orderkey % 3 = 0 then null else l_returnflag end is not null group by 1""",
)
def _(t):
    from wardline.functions.text import non_blank

    rows = t.lineitem.select(
        "l_returnflag", F.when(F.col("l_linenumber") > 3, "").otherwise(F.col("l_linestatus")).alias("a"),
        F.when(F.col("l_orderkey") % 3 != 0, F.col("l_returnflag")).alias("b"),
    )
    return rows.filter(non_blank("a") & non_blank("b")).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


C7 = f"""with {SCORED} select incident_id, site from scored
  where (contains(lower(text), 'a') or contains(lower(site), 'a')) and """


@query("c7_workspace_no_rule", C7 + "not predicted and not sparse and incident_id not in (select user_id from events)")
def _(t):
    return f.filter_incidents(
        t.incidents(), text="A", text_cols=["narrative", "site"], rule="no_rule", tags=doc_tags(t),
        predictions=t.predictions(), psif="not_psif",
    ).select("incident_id", "site")


@query("c7_workspace_sparse", C7 + "sparse")
def _(t):
    return f.filter_incidents(
        t.incidents(), text="a", text_cols=["narrative", "site"], predictions=t.predictions(), psif="sparse"
    ).select("incident_id", "site")


@query("f19_risk_band", """select case when s < 250 then 'low' when s < 500 then 'medium' when s < 750 then 'high'
    else 'critical' end as band, count(*) as n from (select (doc_id * 37) % 1000 as s from documents) group by 1""")
def _(t):
    return t.predictions().groupBy(risk_band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
