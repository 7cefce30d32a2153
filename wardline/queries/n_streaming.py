"""Streaming jobs run to completion over the given tables; the results equal the batch ones."""

from pyspark.sql import functions as F

from wardline.operators.mapping import with_stable_id
from wardline.operators.quality import ReportColumns, quality_gate
from wardline.operators.tagging import tag_rules
from wardline.plans.scale import work_folder
from wardline.queries.c_quality import ODD_GATED, odd_text
from wardline.queries.l_sources import UUID_SQL
from wardline.queries.registry import query
from wardline.streaming import jobs as j

RULES = {"Alpha": (r"the",), "Beta": (r"que",)}


def table_stream(t, name):
    """A table as a stream of its files, be it one file or a folder of them; a plain path would have to be a folder, a pattern need not."""
    return j.file_stream(t.spark, f"{t.folder}/{{{name}.parquet}}", getattr(t, name).schema)


def ingested(t, repeat=False):
    """Documents through the ingestion job; returns its folder."""
    target = work_folder(t.spark, "ingest")
    source = table_stream(t, "documents")
    if repeat:
        source = source.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")

    def prepare(batch):
        rows = batch.select("doc_id", F.col("source").alias("dataset_id"), odd_text(F.col("text")).alias("text"), "lang")
        known = with_stable_id(rows, "dataset_id", "doc_id", None)
        return quality_gate(known, ReportColumns("text", activity="lang"), with_dates=False)

    def tag(accepted):
        return tag_rules(accepted, "incident_id", {"narrative": "text"}, RULES, contexts=False)

    j.ingest_stream(source, prepare, tag, target).awaitTermination()
    return target


STREAMED = ODD_GATED + f""", s as (select d.doc_id, d.source as dataset_id, {UUID_SQL.replace("doc_id)", "d.doc_id)").replace("(source", "(d.source")} as incident_id, c.chk, c.text
  from checked c join documents d using (doc_id))"""


@query(
    "s1_ingest_accepted",
    STREAMED + " select doc_id, incident_id, dataset_id from s where coalesce(chk, 'SHORT_NARRATIVE') = 'SHORT_NARRATIVE'",
)
def _(t):
    return t.spark.read.parquet(f"{ingested(t)}/accepted").select("doc_id", "incident_id", "dataset_id")


@query(
    "s1_ingest_tags",
    STREAMED + r""", ok as (select * from s where coalesce(chk, 'SHORT_NARRATIVE') = 'SHORT_NARRATIVE')
    select incident_id, 'Alpha' as rule from ok where regexp_matches(text, '(?i)(?:^|[^\pL\pM\p{Nd}\p{Nl}\p{Pc}])the(?:[^\pL\pM\p{Nd}\p{Nl}\p{Pc}]|$)')
    union all select incident_id, 'Beta' from ok where regexp_matches(text, '(?i)(?:^|[^\pL\pM\p{Nd}\p{Nl}\p{Pc}])que(?:[^\pL\pM\p{Nd}\p{Nl}\p{Pc}]|$)')""",
)
def _(t):
    return t.spark.read.parquet(f"{ingested(t)}/tags").select("incident_id", "rule")


@query(
    "s2_exactly_once",
    STREAMED + " select doc_id, incident_id, 1::bigint as n from s where coalesce(chk, 'SHORT_NARRATIVE') = 'SHORT_NARRATIVE'",
)
def _(t):
    rows = t.spark.read.parquet(f"{ingested(t, repeat=True)}/accepted")
    return rows.groupBy("doc_id", "incident_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s3_live_counters",
    "select event_type, user_id % 3 as state, count(*) as rows from events group by 1, 2",
)
def _(t):
    target = work_folder(t.spark, "counters")
    stream = table_stream(t, "events")
    j.run_to_table(j.live_counters(stream.withColumn("state", F.col("user_id") % 3), "event_type", "state"), target, "update")
    return j.latest(t.spark.read.parquet(f"{target}/result"), "event_type", "state")


@query(
    "s4_recurrence_alerts",
    """with w as (select event_type, user_id, ts, unnest(generate_series(0, 6)) as back from events),
    x as (select event_type, user_id, ts, (ts::date - back::int) as start from w)
    select strftime(start, '%Y-%m-%d') as start, event_type, user_id, count(*) as incidents from x
    where start + 7 <= (select max(ts) - interval 2 day from events) group by 1, 2, 3 having count(*) >= 5""",
)
def _(t):
    target = work_folder(t.spark, "alerts")
    stream = table_stream(t, "events")
    alerts = j.recurrence_alerts(stream, "ts", ["event_type", "user_id"], "event_id", min_count=5)
    rows = alerts.select(
        F.date_format("window.start", "yyyy-MM-dd").alias("start"), "event_type", "user_id", "incidents"
    )
    j.run_to_table(rows, target)
    return t.spark.read.parquet(f"{target}/result").drop(j.BATCH)


@query(
    "s5_rejected",
    STREAMED + " select incident_id, chk as checks from s where coalesce(chk, 'SHORT_NARRATIVE') <> 'SHORT_NARRATIVE'",
)
def _(t):
    rows = t.spark.read.parquet(f"{ingested(t)}/rejected")
    return rows.select("incident_id", F.array_join("blocking_checks", ",").alias("checks"))
