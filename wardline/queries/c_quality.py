"""Data-quality operators over the documents and dated tables."""

from pyspark.sql import functions as F

from wardline.operators import quality as q
from wardline.queries.registry import query
from wardline.queries.sqltext import ALNUM, NOT_WS, WS, pct_sql, strip_sql, values_sql, words_sql
from wardline.rules.quality import HAZARD_CUES, PLACEHOLDERS

SINGLE = "|".join(p.replace("/", "\\/") for p in PLACEHOLDERS if " " not in p and any(c.isalnum() for c in p))
EDGE = r"[,.!?\"'';:()]*"
PLACEHOLDER_RE = rf"^(?:{WS}*(?:{EDGE}(?:{SINGLE}){EDGE}|\p{{Nd}}+|[^\t\n\x0b\f\r \x{{85}}\pZ\pL\pN]+)(?:{WS}+|$))+$"

CHECKED = f"""base as (select doc_id, source, lang, n_chars, text, {strip_sql("text")} as t, lower({strip_sql("text")}) as low,
    {words_sql("text")} as words from documents),
  alnum as (select *, regexp_replace(low, '[^\\pL\\pN]+', '', 'g') as a from base),
  checked as (select *, case
    when t = '' then 'MISSING_NARRATIVE'
    when contains(t, chr(65533)) then 'UNSUPPORTED_ENCODING'
    when a = '' then 'MEANINGLESS_NARRATIVE'
    when low in ({", ".join(repr(p) for p in PLACEHOLDERS)})
      or regexp_matches(low, '^(?:desc|test|sample|incident|dummy|asdf)\\s*\\d*$')
      or regexp_matches(low, '{PLACEHOLDER_RE}') then 'PLACEHOLDER_NARRATIVE'
    when length(t) >= 4 and replace(a, a[1], '') = '' then 'CORRUPTED_NARRATIVE'
    when length(a) >= 4 and not regexp_matches(low, '[aeiouy]') then 'CORRUPTED_NARRATIVE'
    when contains(low, 'asdfghjkl') or contains(low, 'qwertyuiop') or contains(low, 'zxcvbnm')
      or regexp_matches(t, '^[\\d\\s]+$') then 'MEANINGLESS_NARRATIVE'
    when words = 1 then case when length(trim(regexp_extract(low, '{NOT_WS}*{ALNUM}{NOT_WS}*', 0), ',.!?"'';:()')) > 3
      and not regexp_matches(trim(regexp_extract(low, '{NOT_WS}*{ALNUM}{NOT_WS}*', 0), ',.!?"'';:()'), '[aeiouy]')
      then 'CORRUPTED_NARRATIVE' else 'INSUFFICIENT_NARRATIVE' end
    when words < 10 then 'SHORT_NARRATIVE' end as chk from alnum)"""


@query(
    "d1_check_narrative",
    f"""with {CHECKED} select doc_id, chk as narrative_check, case when chk = 'SHORT_NARRATIVE' then 'warning'
      when chk is not null then 'critical' end as severity from checked""",
)
def _(t):
    out = q.check_narrative(t.documents, "text")
    return out.select("doc_id", "narrative_check", F.col("narrative_check_severity").alias("severity"))


def odd_text(column):
    """Document texts turned into every bad shape by id, so that all branches of the gate fire."""
    r = F.col("doc_id") % 13
    word = F.regexp_extract(column, r"[A-Za-z]+", 0)
    return (
        F.when(r == 0, F.lit("  "))
        .when(r == 1, F.concat(F.lit("�"), column))
        .when(r == 2, F.lit("?! ---"))
        .when(r == 3, F.lit("N/A"))
        .when(r == 4, F.concat(F.lit("Test "), F.col("doc_id").cast("string")))
        .when(r == 5, F.lit("aaaa AAAA a"))
        .when(r == 6, F.lit("bcd fgh"))
        .when(r == 7, F.concat(F.lit("xx asdfghjkl "), column))
        .when(r == 8, word)
        .when(r == 9, F.concat(word, F.lit(" "), word, F.lit(" ok.")))
        .when(r == 10, F.lit("tbd, none. 42"))
        .otherwise(column)
    )


ODD_SQL = """documents_odd as (select doc_id, case doc_id % 13 when 0 then '  ' when 1 then chr(65533) || text
  when 2 then '?! ---' when 3 then 'N/A' when 4 then 'Test ' || doc_id when 5 then 'aaaa AAAA a' when 6 then 'bcd fgh'
  when 7 then 'xx asdfghjkl ' || text when 8 then regexp_extract(text, '[A-Za-z]+', 0)
  when 9 then regexp_extract(text, '[A-Za-z]+', 0) || ' ' || regexp_extract(text, '[A-Za-z]+', 0) || ' ok.'
  when 10 then 'tbd, none. 42' else text end as text, source, lang, n_chars from documents)"""


@query(
    "d1_check_narrative_branches",
    f"""with {ODD_SQL}, {CHECKED.replace("from documents)", "from documents_odd)")}
      select doc_id, chk as narrative_check from checked""",
)
def _(t):
    docs = t.documents.select("doc_id", odd_text(F.col("text")).alias("text"))
    return q.check_narrative(docs, "text").select("doc_id", "narrative_check")


COLS = q.ReportColumns(narrative="text", activity="activity", location="location")


def located(t):
    r = F.col("doc_id") % 6
    return t.documents.select(
        "doc_id", "text", "lang", "source", "n_chars",
        F.when(r == 0, "").otherwise(F.col("lang")).alias("activity"),
        F.when(r == 1, "Unknown").when(r == 2, "N/A ").otherwise(F.col("source")).alias("location"),
    )


@query(
    "d2_check_fields",
    f"""with f as (select doc_id, unnest(list_filter([
        case when {strip_sql("text")} = '' and doc_id % 6 = 0 then 'MISSING_ACTIVITY' end,
        case when {strip_sql("text")} <> '' and doc_id % 6 = 0 then 'OPTIONAL_ACTIVITY_MISSING' end,
        case when doc_id % 6 in (1, 2) then 'INVALID_LOCATION' end,
        case when lang not in ('en', 'fr') then 'OUT_OF_DOMAIN' end], lambda x: x is not null)) as check_id from documents)
      select check_id, count(*) as n, sum(doc_id)::bigint as ids from f group by 1""",
)
def _(t):
    out = q.check_fields(located(t), COLS, {"lang": ["en", "fr"]})
    found = out.select("doc_id", F.explode("field_findings").alias("f"))
    return found.groupBy(F.col("f.check_id").alias("check_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")
    )


INJURED = ("His eye injury was noted", "a deep cut and injured her hand", "serious injury, hospitalized",
           "nothing of note happened")
INJURED_SQL = values_sql([(i, s) for i, s in enumerate(INJURED)])


def injured(t):
    """Document texts with a closing sentence and structured injury fields chosen by id."""
    i = F.col("doc_id")
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))
    return t.documents.select(
        "doc_id", F.concat_ws(". ", F.col("text"), pick(INJURED, i)).alias("text"),
        pick(("eye", "left hand", "Back", ""), F.floor(i / 4)).alias("part"),
        pick(("Eye strain", "laceration", "", "burn"), F.floor(i / 16)).alias("injury"),
        pick(("none", "lost_time", "first_aid"), F.floor(i / 64)).alias("severity"),
        (i % 2 == 0).alias("miss"),
    )


@query(
    "d3_check_conflicts",
    f"""with w(i, s) as (values {INJURED_SQL}), r as (
      select doc_id, lower(text || '. ' || s) as x, lower(['eye','left hand','Back',''][(doc_id // 4) % 4 + 1]) as part,
        lower(['Eye strain','laceration','','burn'][(doc_id // 16) % 4 + 1]) as injury,
        ['none','lost_time','first_aid'][(doc_id // 64) % 3 + 1] as sev, doc_id % 2 = 0 as miss
      from documents join w on doc_id % 4 = i),
    f as (select doc_id, unnest(list_concat(
      [case when contains(injury, 'eye') and regexp_matches(part, 'leg|foot|arm|hand|back|knee')
        then 'INJURY_BODY_PART_CONFLICT' end],
      list_transform(['eye','knee','head','hand','arm','leg','foot'], lambda p: case when part <> '' and not contains(part, p)
        and regexp_matches(x, '(?:^|[^\\pL\\pN_])(?:' || p || ' injury|injured (?:his|her|their)?\\s*' || p ||
          '|injury to (?:the\\s+)?' || p || ')(?:[^\\pL\\pN_]|$)') then 'INJURY_BODY_PART_CONFLICT' end),
      [case when injury <> '' and not contains(injury, 'fracture') and regexp_matches(x,
          '(?:^|[^\\pL\\pN_])(fracture|fractured|broken bone)(?:[^\\pL\\pN_]|$)') then 'INJURY_TYPE_CONFLICT' end,
       case when injury <> '' and not contains(injury, 'laceration') and regexp_matches(x,
          '(?:^|[^\\pL\\pN_])(laceration|deep cut|sliced)(?:[^\\pL\\pN_]|$)') then 'INJURY_TYPE_CONFLICT' end,
       case when injury <> '' and not contains(injury, 'burn') and regexp_matches(x,
          '(?:^|[^\\pL\\pN_])(burn|burned|chemical burn)(?:[^\\pL\\pN_]|$)') then 'INJURY_TYPE_CONFLICT' end,
       case when sev = 'none' and regexp_matches(x, 'serious injury|hospitalized') then 'SEVERITY_NARRATIVE_CONFLICT' end,
       case when miss and sev = 'lost_time' then 'NEAR_MISS_SEVERITY_CONFLICT' end,
       case when miss and sev <> 'lost_time' and regexp_matches(x, 'laceration|fracture|hospitalized')
         then 'NEAR_MISS_INJURY_CONFLICT' end])) as check_id from r)
    select check_id, count(*) as n, sum(doc_id)::bigint as ids from f where check_id is not null group by 1""",
)
def _(t):
    cols = q.ReportColumns("text", body_part="part", injury_type="injury", severity="severity", near_miss="miss")
    out = q.check_conflicts(injured(t), cols).select("doc_id", F.explode("conflict_findings").alias("f"))
    return out.groupBy(F.col("f.check_id").alias("check_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")
    )


@query(
    "d4_check_dates",
    """with r as (select l_orderkey as id, case when l_linenumber = 7 then null
        when l_linenumber = 6 then date '1960-05-05' else l_shipdate::date end as day,
        (o_orderdate + interval 60 day)::date as rep from lineitem join orders on l_orderkey = o_orderkey),
    f as (select id, unnest([case when day > date '2001-06-01' then 'FUTURE_DATE' end,
      case when day <= date '2001-06-01' and (year(day) < 1970 or year(day) > 2050) then 'IMPOSSIBLE_DATE' end,
      case when day > rep then 'CONTRADICTORY_DATE' end, case when day is null then 'MISSING_DATE' end]) as check_id
      from r)
    select check_id, count(*) as n, sum(id)::bigint as ids from f where check_id is not null group by 1""",
)
def _(t):
    n = F.col("l_linenumber")
    day = F.when(n == 7, None).when(n == 6, F.to_date(F.lit("1960-05-05"))).otherwise(F.to_date("l_shipdate"))
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", day.alias("day"), F.date_add(F.to_date("o_orderdate"), 60).alias("rep")
    )
    cols = q.ReportColumns("l_orderkey", incident_date="day", report_date="rep")
    out = q.check_dates(rows, cols, F.to_date(F.lit("2001-06-01"))).select(
        "l_orderkey", F.explode("date_findings").alias("f")
    )
    return out.groupBy(F.col("f.check_id").alias("check_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("ids")
    )


GATED = f"""{CHECKED}, gated as (select *, case when coalesce(chk, 'SHORT_NARRATIVE') <> 'SHORT_NARRATIVE' then 'CRITICAL'
    when chk is not null or doc_id % 6 in (1, 2) then 'WARNING' else 'VALID' end as status from checked)"""


def gated(t):
    return q.quality_gate(located(t), COLS, with_dates=False)


@query(
    "d5_quality_gate",
    f"""with {GATED} select doc_id, status as quality_status, status <> 'CRITICAL' as accepted,
      case status when 'CRITICAL' then 0.0 when 'WARNING' then 0.75 else 1.0 end::double as quality_score,
      (chk is not null)::bigint + (doc_id % 6 in (1, 2))::bigint + (doc_id % 6 = 0)::bigint as findings,
      case when chk in ('MISSING_NARRATIVE','INSUFFICIENT_NARRATIVE') then 'description' else '' end as missing
      from gated""",
)
def _(t):
    return gated(t).select(
        "doc_id", "quality_status", "accepted", "quality_score", F.size("findings").cast("long").alias("findings"),
        F.array_join("missing_fields", ",").alias("missing"),
    )


def odd_gated(t):
    return q.quality_gate(
        t.documents.select("doc_id", odd_text(F.col("text")).alias("text"), "lang"),
        q.ReportColumns("text", activity="lang"), with_dates=False,
    )


ODD_GATED = f"with {ODD_SQL}, {CHECKED.replace('from documents)', 'from documents_odd)')}"


@query(
    "d6_split_accepted",
    ODD_GATED + " select doc_id, lang from checked where coalesce(chk, 'SHORT_NARRATIVE') = 'SHORT_NARRATIVE'",
)
def _(t):
    return q.split_by_gate(odd_gated(t), "doc_id")[0].select("doc_id", "lang")


@query(
    "d6_split_rejected",
    ODD_GATED + """ select doc_id, 'Data quality is insufficient for analysis.' as reason, chk as checks from checked
      where coalesce(chk, 'SHORT_NARRATIVE') <> 'SHORT_NARRATIVE'""",
)
def _(t):
    rejects = q.split_by_gate(odd_gated(t), "doc_id")[1]
    return rejects.select("doc_id", "reason", F.array_join("blocking_checks", ",").alias("checks"))


@query(
    "d7_gate_summary",
    f"""with {GATED} select source, count(*) as total, count(*) filter (status <> 'CRITICAL') as accepted,
      count(*) filter (status = 'WARNING') as with_warnings, count(*) filter (status = 'CRITICAL') as rejected
      from gated group by 1""",
)
def _(t):
    return q.gate_summary(gated(t), "source")


PRINT_SQL = r"""case when coalesce(text, '') = '' then '' else substr(sha256(lower(array_to_string(
  regexp_extract_all(regexp_replace(text, '[\pL\pN_\pM]*[^\x00-\x7F\PL][\pL\pN_\pM]*|[\pL\pN\pM_]*[_\pM][\pL\pN\pM_]*', ' ', 'g'), '[a-zA-Z0-9]+'), ' '))), 1, 16) end"""


@query("d8_fingerprint", f"select doc_id, {PRINT_SQL} as fingerprint from documents")
def _(t):
    return t.documents.select("doc_id", q.fingerprint(F.col("text")).alias("fingerprint"))


@query(
    "d8_duplicate_groups",
    f"""select fingerprint, count(*) as copies, min(doc_id) as first_id from
      (select doc_id, {PRINT_SQL} as fingerprint from documents) where fingerprint <> '' group by 1 having count(*) > 1""",
)
def _(t):
    return q.duplicate_groups(t.documents, "text", "doc_id")


CUES = " or ".join(f"contains(lower(text), '{c}')" for c in HAZARD_CUES)


@query(
    "d9_evidence_state",
    f"""with {GATED} select doc_id, case when status = 'CRITICAL' then 'INVALID_DATA'
      when chk = 'SHORT_NARRATIVE' or doc_id % 29 = 0 then 'SPARSE_DATA'
      when doc_id % 17 = 0 then 'INSUFFICIENT_INFORMATION' when not ({CUES}) then 'VALID_LOW_EVIDENCE'
      else 'VALID' end as evidence_state from gated""",
)
def _(t):
    out = q.evidence_state(gated(t), "text", F.col("doc_id") % 29 == 0, F.col("doc_id") % 17 == 0)
    return out.select("doc_id", "evidence_state")


@query(
    "d10_quality_report",
    f"""with {GATED}, c as (select source, count(*) as total, count(*) filter (status = 'VALID' and doc_id % 19 > 0) as valid,
        count(*) filter (status = 'WARNING' and doc_id % 19 > 0) as warning,
        count(*) filter (status = 'CRITICAL' and doc_id % 19 > 0) as critical,
        count(*) filter (doc_id % 19 = 0) as pending, count(*) filter (words < 10) as sparse,
        count(*) filter (doc_id % 6 = 0) as missing_activity, count(*) filter (t = '' and text = '') as missing_narrative
        from gated group by 1),
    l as (unpivot c on valid, warning, critical, pending, sparse, missing_activity, missing_narrative
      into name measure value n)
    select source, measure, n, {pct_sql("n", "total", 2)} as rate from l""",
)
def _(t):
    from wardline.functions.text import is_sparse

    df = gated(t).withColumn("status", F.when(F.col("doc_id") % 19 > 0, F.col("quality_status")))
    fields = {"activity": "activity", "narrative": "text"}
    return q.quality_report(df, "status", fields, is_sparse("text"), ["source"])
