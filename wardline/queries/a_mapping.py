"""Mapping, typing, cleaning and identity of reports."""

from pyspark.sql import functions as F

from wardline.functions import codes, text
from wardline.operators import mapping as m
from wardline.queries.registry import query
from wardline.queries.sqltext import FIELD_ALIAS_VALUES, WS, clean_sql, code_sql, sparse_sql
from wardline.rules.fields import CANONICAL_FIELDS, SEVERITY_ACTUAL, SEVERITY_POTENTIAL


def event_maps(t):
    """Events as string maps whose keys differ by source."""
    key = F.when(F.col("event_type") == "error", "report id").otherwise("Activity-Performed")
    return t.events.select(
        F.col("event_type").alias("source"),
        F.col("event_id").alias("row_id"),
        F.create_map(
            F.lit("Event_ID"), F.col("event_id").cast("string"),
            F.lit("incident_date"), F.date_format("ts", "yyyy-MM-dd"),
            key, F.col("event_type"),
            F.lit("Site"), F.col("user_id").cast("string"),
            F.lit("zz99"), F.col("props"),
        ).alias("row_values"),
    )


EVENT_KEYS = """
long as (
  select event_type as source, event_id as row_id, 1 as pos, 'Event_ID' as key, event_id::varchar as value from events
  union all select event_type, event_id, 2, 'incident_date', strftime(ts, '%Y-%m-%d') from events
  union all select event_type, event_id, 3,
    case when event_type = 'error' then 'report id' else 'Activity-Performed' end, event_type from events
  union all select event_type, event_id, 4, 'Site', user_id::varchar from events
  union all select event_type, event_id, 5, 'zz99', props from events)
"""

HARMONISE_SQL = f"""
with alias(ord, alias, canonical) as (values {FIELD_ALIAS_VALUES}),
{EVENT_KEYS},
keys as (select source, key, min(pos) as pos from long group by 1, 2),
named as (select *, lower(replace(replace(trim(key), '_', ' '), '-', ' ')) as norm from keys),
hits as (
  select source, key, pos, replace(norm, ' ', '_') as canonical, 100000 as len, 0 as ord from named
  where replace(norm, ' ', '_') in (select distinct canonical from alias)
  union all
  select n.source, n.key, n.pos, a.canonical, length(a.alias), a.ord from named n join alias a
    on contains(n.norm, a.alias) or contains(a.alias, n.norm)),
best as (select * from hits qualify row_number() over (partition by source, key order by len desc, ord) = 1),
target as (select * from best qualify row_number() over (partition by source, canonical order by pos, key) = 1)
select l.source, l.row_id, t.canonical, l.value from long l join target t on l.source = t.source and l.key = t.key
"""


@query("b1_harmonise_keys", HARMONISE_SQL)
def _(t):
    return m.harmonise_keys(event_maps(t), "source", "row_id", "row_values")


@query(
    "b1_pivot_fields",
    HARMONISE_SQL.replace("select l.source, l.row_id, t.canonical, l.value", """
select l.source, l.row_id, max(case when t.canonical = 'incident_date' then l.value end) as incident_date,
  max(case when t.canonical = 'location' then l.value end) as location,
  max(case when t.canonical = 'external_id' then l.value end) as external_id,
  max(case when t.canonical = 'job_task' then l.value end) as job_task""") + " group by 1, 2",
)
def _(t):
    long = m.harmonise_keys(event_maps(t), "source", "row_id", "row_values")
    return m.pivot_fields(long, "source", "row_id", ["incident_date", "location", "external_id", "job_task"])


CONFLICT_MAP = """select distinct o_orderstatus as source, o_orderpriority || '/' || (o_custkey % 3) as key,
  case o_orderkey % 6 when 0 then 'department' when 1 then 'location' when 2 then 'colour' when 3 then ''
    when 4 then 'near_miss' end as canonical from orders"""


@query(
    "b2_mapping_conflicts",
    f"""with m as ({CONFLICT_MAP}),
    g as (select source, canonical, count(distinct key) as keys from m where coalesce(canonical, '') <> '' group by 1, 2)
    select source, canonical, case when canonical not in ({", ".join(f"'{f}'" for f in CANONICAL_FIELDS)})
      then 'UNKNOWN_TARGET' else 'DUPLICATE_TARGET' end as problem, keys from g
    where canonical not in ({", ".join(f"'{f}'" for f in CANONICAL_FIELDS)}) or keys > 1""",
)
def _(t):
    r = F.col("o_orderkey") % 6
    target = (
        F.when(r == 0, "department").when(r == 1, "location").when(r == 2, "colour").when(r == 3, "")
        .when(r == 4, "near_miss")
    )
    key = F.concat("o_orderpriority", F.lit("/"), (F.col("o_custkey") % 3).cast("string"))
    table = t.orders.select(
        F.col("o_orderstatus").alias("source"), key.alias("key"), target.alias("canonical")
    ).distinct()
    return m.mapping_conflicts(table, "source", "key", "canonical")


@query(
    "b3_apply_mapping",
    f"""select doc_id, md5(nullif(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '')) as description,
    nullif(trim(source), '') as location,
    nullif(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '') as job_task from documents""",
)
def _(t):
    out = m.apply_mapping(t.documents, {"description": "text", "location": "source", "job_task": "text"}, ["doc_id"])
    return out.withColumn("description", F.md5(F.col("description")))


@query("b4_severity_actual", f"""select o_orderpriority as raw, {code_sql("o_orderpriority", SEVERITY_ACTUAL)} as code,
    count(*) as n from orders group by 1, 2
    union all select lower(c_mktsegment), {code_sql("lower(c_mktsegment)", SEVERITY_ACTUAL)}, count(*)
    from customer group by 1, 2""")
def _(t):
    a = t.orders.select(F.col("o_orderpriority").alias("raw"))
    b = t.customer.select(F.lower("c_mktsegment").alias("raw"))
    return a.unionByName(b).groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select(
        "raw", codes.normalise_code(F.col("raw"), SEVERITY_ACTUAL).alias("code"), "n"
    )


@query("b5_severity_potential", f"""select o_orderpriority as raw,
    {code_sql("substr(o_orderpriority, 3)", SEVERITY_POTENTIAL)} as code, count(*) as n from orders group by 1, 2""")
def _(t):
    code = codes.normalise_code(F.substring("o_orderpriority", 3, 99), SEVERITY_POTENTIAL)
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("o_orderpriority").alias("raw"), code.alias("code"), "n"
    )


@query(
    "b6_parse_flag",
    """with v as (select l_orderkey as id, case l_linenumber % 4 when 0 then l_returnflag when 1 then ' Yes '
        when 2 then (l_orderkey % 3)::varchar else null end as raw from lineitem),
    p as (select id, case when lower(trim(raw)) in ('true','yes','y','1','x','near miss','near-miss') then true
        when lower(trim(raw)) in ('false','no','n','0','') then false end as flag from v)
    select flag, count(*) as n, sum(id)::bigint as id_sum from p group by 1""",
)
def _(t):
    r = F.col("l_linenumber") % 4
    raw = F.when(r == 0, F.col("l_returnflag")).when(r == 1, " Yes ").when(
        r == 2, (F.col("l_orderkey") % 3).cast("string")
    )
    return t.lineitem.groupBy(codes.parse_flag(raw).alias("flag")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("id_sum")
    )


@query(
    "b7_parse_date",
    """select o_orderkey, case when o_orderkey % 16 < 14 then o_orderdate::date end as day from orders""",
)
def _(t):
    forms = (
        "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
        "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "yyyy-MM-dd HH:mm", "M/d/yyyy", "M/d/yyyy H:mm", "MMM d, yyyy", "d MMMM yyyy", "dd-MM-yyyy", "d.M.yyyy",
    )
    raw = F.when(F.col("o_orderkey") % 16 == 14, "NaT").otherwise("99th of never")
    for i, form in enumerate(forms):
        raw = F.when(F.col("o_orderkey") % 16 == i, F.date_format("o_orderdate", form)).otherwise(raw)
    return t.orders.select("o_orderkey", codes.parse_date(raw).alias("day"))


@query(
    "b8_raw_row",
    """select conv_id, turn, md5(to_json({'conv_id': conv_id, 'turn': turn, 'role': role, 'text': text})::varchar)
      as raw_row from conversations""",
)
def _(t):
    c = t.conversations.select("conv_id", "turn", "role", "text")
    return m.with_raw_row(c).select("conv_id", "turn", F.md5(F.col("raw_row")).alias("raw_row"))


@query(
    "b9_stable_id",
    """with h as (select doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') ||
        case when doc_id % 2 = 0 then source || ':ext:' || doc_id else source || ':row:' || n_chars end::blob) as d
      from documents)
    select doc_id, substr(d,1,8) || '-' || substr(d,9,4) || '-5' || substr(d,14,3) || '-' ||
      substr('89ab', (strpos('0123456789abcdef', substr(d,17,1))::int - 1) % 4 + 1, 1) || substr(d,18,3) || '-' ||
      substr(d,21,12) as incident_id from h""",
)
def _(t):
    d = t.documents.withColumn("ext", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")))
    return m.with_stable_id(d, "source", "ext", "n_chars").select("doc_id", "incident_id")


@query(
    "b10_provenance",
    """select o_orderkey, c_mktsegment as workspace_id, coalesce(c_custkey % 2 = 0, false) as is_synthetic,
      case c_custkey % 4 when 0 then 'real_external' when 1 then 'real_human' when 2 then 'synthetic' else 'none' end
      as label_source from orders left join customer on o_custkey = c_custkey""",
)
def _(t):
    r = F.col("c_custkey") % 4
    sets = t.customer.select(
        F.col("c_custkey").alias("dataset_id"), F.col("c_mktsegment").alias("workspace_id"),
        (F.col("c_custkey") % 2 == 0).alias("is_synthetic"),
        F.when(r == 0, "REAL_EXTERNAL").when(r == 1, "REAL_HUMAN").when(r == 2, "SYNTHETIC").otherwise("OTHER")
        .alias("source_provenance"),
    )
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("dataset_id"))
    return m.stamp_provenance(rows, sets).drop("dataset_id")


@query("b11_clean_text", f"select page_id, md5({clean_sql('html')}) as digest, length({clean_sql('html')}) as n from pages")
def _(t):
    cleaned = t.pages.select("page_id", text.clean_text("html").alias("c"))
    return cleaned.select("page_id", F.md5("c").alias("digest"), F.length("c").cast("long").alias("n"))


@query(
    "b12_compose_text",
    f"""select page_id, md5(concat_ws(' [SEP] ', nullif({clean_sql("html")}, ''),
      nullif({clean_sql("case when page_id % 3 = 0 then '  ' else url end")}, ''), nullif({clean_sql("null")}, '')))
      as digest from pages""",
)
def _(t):
    url = F.when(F.col("page_id") % 3 == 0, "  ").otherwise(F.col("url"))
    return t.pages.select(
        "page_id", F.md5(text.compose_text(["html", url, F.lit(None).cast("string")])).alias("digest")
    )


@query("b13_is_sparse", f"select doc_id, {sparse_sql('text')} as sparse from documents")
def _(t):
    return t.documents.select("doc_id", text.is_sparse("text").alias("sparse"))


@query(
    "b14_derive_flags",
    """with r as (select l_orderkey, l_linenumber, case l_linenumber when 1 then 'failed' when 2 then 'bypassed'
        when 3 then 'effective' when 4 then 'absent' else 'unknown' end as cond,
        case l_returnflag when 'A' then 'near_miss' when 'N' then 'incident' else 'unsafe_act' end as rt,
        case when l_linestatus = 'F' then 'none' when l_orderkey % 2 = 0 then 'lost_time' end as sev,
        case when l_orderkey % 5 = 0 then false end as given from lineitem)
    select l_orderkey, l_linenumber,
      case when cond in ('failed','bypassed') then true when cond in ('effective','absent') then false else given end
        as failed,
      coalesce(given, case when rt = 'near_miss' then true when rt = 'incident' and sev <> 'none' then false end)
        as near_miss from r""",
)
def _(t):
    n = F.col("l_linenumber")
    given = F.when(F.col("l_orderkey") % 5 == 0, F.lit(False))
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.when(n == 1, "failed").when(n == 2, "bypassed").when(n == 3, "effective").when(n == 4, "absent")
        .otherwise("unknown").alias("cond"),
        F.when(F.col("l_returnflag") == "A", "near_miss").when(F.col("l_returnflag") == "N", "incident")
        .otherwise("unsafe_act").alias("rt"),
        F.when(F.col("l_linestatus") == "F", "none").when(F.col("l_orderkey") % 2 == 0, "lost_time").alias("sev"),
        given.alias("failed"), given.alias("near_miss"),
    )
    out = m.derive_flags(rows, "cond", "failed", "rt", "near_miss", "sev")
    return out.select("l_orderkey", "l_linenumber", "failed", "near_miss")


@query(
    "p1_prediction_record",
    "select doc_id, md5(text) as description, source as department, lang as job_task from documents",
)
def _(t):
    wide = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.md5("text").alias("description"), F.col("source").alias("department"),
        F.col("lang").alias("job_task"), F.col("quality").alias("is_psif_human_label"),
        F.col("toxic").alias("severity_actual"),
    )
    return m.prediction_record(wide, ["doc_id"])
