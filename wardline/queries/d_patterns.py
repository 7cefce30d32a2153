"""Pattern operators over events as observations: three observations per incident."""

from pyspark.sql import functions as F

from wardline.operators import patterns as p
from wardline.queries.registry import query
from wardline.queries.sqltext import pct_sql, ratio_sql


def obs(t):
    incident = F.floor(F.col("event_id") / 3)
    k = F.get_json_object("props", "$.k").cast("int")
    place = F.when(incident % 7 == 0, p.UNKNOWN_LOCATION).otherwise(F.concat(F.lit("Z"), (incident % 7).cast("string")))
    which = F.col("event_id") % 3
    return t.events.select(
        incident.alias("incident_id"),
        F.when(incident % 13 > 0, F.date_add(F.to_date("ts"), (k * 2).cast("int"))).alias("day"),
        F.when(incident % 10 == 0, "INSUFFICIENT_INFORMATION").when(incident % 2 == 0, "PSIF").otherwise("NOT_PSIF")
        .alias("psif_state"),
        place.alias("location"),
        F.when(which == 0, "activity").when(which == 1, "location").otherwise("barrier").alias("dimension"),
        F.when(which == 0, F.when(F.col("event_type") == "error", p.UNKNOWN_ACTIVITY).otherwise(F.col("event_type")))
        .when(which == 1, place).otherwise(F.concat(F.lit("B"), (F.col("user_id") % 5).cast("string"))).alias("value"),
        F.when(which == 2, F.element_at(
            F.array(*[F.lit(s) for s in ("EFFECTIVE", "ABSENT", "UNKNOWN", "FAILED", "RESTORED_BEFORE_EXPOSURE")]),
            (k % 5 + 1).cast("int"),
        )).alias("control_state"),
        F.when((which == 2) & (k % 4 > 0), F.concat(F.lit("rule"), (k % 4).cast("string"))).alias("rule"),
    )


OBS = """e as (select event_id // 3 as incident_id, event_id % 3 as which, (props->>'$.k')::int as k, * from events),
obs as (select incident_id, case when incident_id % 13 > 0 then (ts::date + (k * 2)) end as day,
  case when incident_id % 10 = 0 then 'INSUFFICIENT_INFORMATION' when incident_id % 2 = 0 then 'PSIF' else 'NOT_PSIF'
    end as psif_state,
  case when incident_id % 7 = 0 then 'UNKNOWN LOCATION' else 'Z' || (incident_id % 7) end as location,
  ['activity', 'location', 'barrier'][which + 1] as dimension,
  case which when 0 then case when event_type = 'error' then 'UNKNOWN ACTIVITY' else event_type end
    when 1 then case when incident_id % 7 = 0 then 'UNKNOWN LOCATION' else 'Z' || (incident_id % 7) end
    else 'B' || (user_id % 5) end as value,
  case when which = 2 then ['EFFECTIVE','ABSENT','UNKNOWN','FAILED','RESTORED_BEFORE_EXPOSURE'][k % 5 + 1] end
    as control_state,
  case when which = 2 and k % 4 > 0 then 'rule' || (k % 4) end as rule from e),
cnt as (select dimension, value, count(distinct incident_id) as incidents,
  count(distinct incident_id) filter (psif_state = 'PSIF') as psif_linked,
  count(distinct incident_id) filter (control_state in ('EFFECTIVE','RESTORED_BEFORE_EXPOSURE')) as effective,
  count(distinct incident_id) filter (control_state in ('ABSENT','FAILED')) as deficient from obs group by 1, 2),
total as (select count(distinct incident_id) as n from obs)"""
RATE = pct_sql("psif_linked", "incidents") + " as rate"


def listed(column):
    """array<struct<value,n>> as text."""
    return F.array_join(F.transform(column, lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), ";")


@query(
    "g1_observations",
    """with d as (select doc_id as incident_id, source as location, lang as activity, (doc_id * 37) % 1000 >= 500 as pred,
        doc_id % 9 = 0 as sparse from documents),
    s as (select *, case when sparse then 'INSUFFICIENT_INFORMATION' when pred then 'PSIF' else 'NOT_PSIF' end as st from d)
    select incident_id, 'activity' as dimension, activity as value, st as psif_state, null::varchar as control_state,
      null::varchar as rule, location from s
    union all select incident_id, 'location', location, st, null, null, location from s
    union all select incident_id, 'barrier', 'guard', st, 'ABSENT', 'Line of Fire', location from s where incident_id % 2 = 0
    union all select incident_id, 'barrier', 'stop', st, 'EFFECTIVE', null, location from s where incident_id % 3 = 0""",
)
def _(t):
    i = F.col("doc_id")
    barrier = lambda name, state, rule: F.struct(
        F.lit(name).alias("name"), F.lit(state).alias("state"), F.lit(rule).cast("string").alias("rule")
    )
    df = t.documents.select(
        i.alias("incident_id"), F.col("source").alias("location"), F.col("lang").alias("activity"),
        F.lit(None).cast("date").alias("day"), (F.pmod(i * 37, F.lit(1000)) >= 500).alias("predicted"),
        (i % 9 == 0).alias("sparse"),
        F.array_compact(F.array(
            F.when(i % 2 == 0, barrier("guard", "ABSENT", "Line of Fire")),
            F.when(i % 3 == 0, barrier("stop", "EFFECTIVE", None)),
        )).alias("barriers"),
    )
    return p.observations(df, barriers="barriers").drop("day")


@query(
    "g9_activity_patterns",
    f"""with {OBS}, s as (select value, string_agg(incident_id, ',' order by incident_id) as sample_ids from
        (select distinct value, incident_id from obs where dimension = 'activity'
         qualify row_number() over (partition by value order by incident_id) <= 10) group by 1)
    select value, incidents, psif_linked, {RATE}, incidents >= 2 as recurring, sample_ids
    from cnt join s using (value) where dimension = 'activity'""".replace(
        "(select distinct value, incident_id from obs where dimension = 'activity'\n         qualify",
        "(select value, incident_id from (select distinct value, incident_id from obs where dimension = 'activity')\n         qualify",
    ),
)
def _(t):
    out = p.activity_patterns(obs(t))
    return out.withColumn("sample_ids", F.array_join(F.col("sample_ids").cast("array<string>"), ","))


@query(
    "g10_barrier_patterns",
    f"""with {OBS}, b as (select * from obs where dimension = 'barrier'),
    st as (select value, control_state from b group by 1, 2
      qualify row_number() over (partition by value order by count(*) desc, control_state) = 1),
    ru as (select value, rule from b where rule is not null group by 1, 2
      qualify row_number() over (partition by value order by count(*) desc, rule) = 1),
    pl as (select value, count(distinct location) as locations from b where location <> 'UNKNOWN LOCATION' group by 1)
    select c.value, incidents, effective, deficient, psif_linked, {RATE}, incidents >= 2 as recurring,
      coalesce(locations, 0) as locations, st.control_state as dominant_state, coalesce(ru.rule, 'None Associated') as top_rule
    from cnt c left join st using (value) left join ru using (value) left join pl using (value)
    where c.dimension = 'barrier'""",
)
def _(t):
    return p.barrier_patterns(obs(t))


@query(
    "g10_state_histogram",
    f"""with {OBS} select value, control_state, count(*) as observations from obs where dimension = 'barrier'
      group by 1, 2""",
)
def _(t):
    return p.state_histogram(obs(t))


LOC_TOP = """(select string_agg(item || '=' || n, ';' order by n desc, item) from (select item, n from items i
  where i.place = c.value and i.kind = '{kind}' order by n desc, item limit 5))"""


@query(
    "g11_location_patterns",
    f"""with {OBS}, kinds as (
      select location as place, 'activity' as kind, value as item from obs where dimension = 'activity'
      union all select location, 'barrier', value from obs where dimension = 'barrier' and control_state in ('ABSENT','FAILED')
      union all select location, 'rule', coalesce(rule, value) from obs where dimension = 'barrier'),
    items as (select place, kind, item, count(*) as n from kinds group by 1, 2, 3),
    ranked as (select *, row_number() over (partition by place, kind order by n desc, item) as rn from items),
    tops as (select place, string_agg(item || '=' || n, ';' order by rn) filter (kind = 'activity' and rn <= 5) as ta,
      string_agg(item || '=' || n, ';' order by rn) filter (kind = 'barrier' and rn <= 5) as tb,
      max(item) filter (kind = 'rule' and rn = 1) as tr, max(item) filter (kind = 'activity' and rn = 1) as a1,
      max(item) filter (kind = 'barrier' and rn = 1) as b1 from ranked group by 1),
    loc as (select *, max(incidents) over () as peak from cnt where dimension = 'location'),
    sc as (select *, (incidents * 200 + peak) // (2 * peak) as sh from loc)
    select value, incidents, psif_linked, {RATE}, {ratio_sql("incidents", "peak", 2)} as intensity,
      case when sh >= 75 then 'critical' when sh >= 50 then 'elevated' when sh >= 25 then 'moderate' else 'low' end as heat,
      incidents >= 2 as recurring, ta as top_activities, tb as top_barriers,
      coalesce(tr, 'General Safety Controls') as top_rule,
      value || ' > ' || coalesce(a1, 'General Site Operations') || ' > ' || coalesce(b1, 'None Observed') as chain
    from sc left join tops on place = value""",
)
def _(t):
    out = p.location_patterns(obs(t))
    return out.withColumns({"top_activities": listed("top_activities"), "top_barriers": listed("top_barriers")})


@query(
    "g11_recent_observations",
    f"""with {OBS}, per as (select location, incident_id, max(day) as day,
        max(value) filter (dimension = 'activity') as activity, bool_or(psif_state = 'PSIF') as is_psif
        from obs group by 1, 2)
    select *, row_number() over (partition by location order by day desc nulls last, incident_id) as rank from per
    qualify row_number() over (partition by location order by day desc nulls last, incident_id) <= 15""",
)
def _(t):
    return p.recent_observations(obs(t))


@query(
    "g12_temporal_patterns",
    f"""with {OBS} select coalesce(strftime(day, '%Y-%m'), 'Undated') as period, count(distinct incident_id) as incidents,
      count(distinct incident_id) filter (psif_state = 'PSIF') as psif_linked from obs where dimension = 'activity' group by 1""",
)
def _(t):
    return p.temporal_patterns(obs(t))


@query(
    "g14_rank_share",
    f"""with {OBS}, known as (select count(distinct incident_id) as k from obs where dimension = 'location'
        and value <> 'UNKNOWN LOCATION')
    select row_number() over (order by incidents desc, value) as rank, value, incidents, psif_linked,
      {pct_sql("incidents", "n")} as share, {pct_sql("k", "n")} as coverage
    from cnt, total, known where dimension = 'location'""",
)
def _(t):
    return p.rank_share(obs(t))


CROSS = """cells as (select location, rule, count(distinct incident_id) as incidents,
  count(distinct incident_id) filter (psif_state = 'PSIF') as psif_linked from obs where rule is not null group by 1, 2)"""


@query(
    "g15_crosstab_totals",
    f"""with {OBS}, {CROSS} select location, rule, case grouping_id(location, rule) when 0 then 'cell' when 1 then 'row'
      when 2 then 'column' else 'all' end as level, sum(incidents)::bigint as incidents,
      sum(psif_linked)::bigint as psif_linked from cells group by cube (location, rule)""",
)
def _(t):
    rows = obs(t).filter(F.col("rule").isNotNull())
    return p.crosstab(rows, "location", "rule", flag=F.col("psif_state") == "PSIF")


@query(
    "g15_crosstab_top_activities",
    f"""with {OBS}, top as (select value from obs where dimension = 'activity' group by 1 order by count(*) desc, value
        limit 3), cells as (select location, value as activity, count(distinct incident_id) as incidents,
          count(distinct incident_id) filter (psif_state = 'PSIF') as psif_linked from obs
          where dimension = 'activity' and value in (select value from top) group by 1, 2)
    select location, activity, case grouping_id(location, activity) when 0 then 'cell' when 1 then 'row'
      when 2 then 'column' else 'all' end as level, sum(incidents)::bigint as incidents,
      sum(psif_linked)::bigint as psif_linked from cells group by cube (location, activity)""",
)
def _(t):
    rows = obs(t).filter(F.col("dimension") == "activity").withColumnRenamed("value", "activity")
    rows = rows.join(p.top_column_values(rows, "activity", 3), "activity", "left_semi")
    return p.crosstab(rows, "location", "activity", flag=F.col("psif_state") == "PSIF")


@query(
    "g16_crosstab_intensity",
    f"""with {OBS}, {CROSS}, peak as (select max(incidents) as m from cells), c as (select location, rule,
        case grouping_id(location, rule) when 0 then 'cell' when 1 then 'row' when 2 then 'column' else 'all' end as level,
        sum(incidents)::bigint as incidents, sum(psif_linked)::bigint as psif_linked from cells group by cube (location, rule))
    select c.*, case when level = 'cell' then case when incidents * 4 < m then 1 when incidents * 2 < m then 2
      when incidents * 4 < m * 3 then 3 else 4 end end::int as intensity from c, peak""",
)
def _(t):
    rows = obs(t).filter(F.col("rule").isNotNull())
    return p.crosstab(rows, "location", "rule", flag=F.col("psif_state") == "PSIF", intensity=True)


@query(
    "g17_activity_view",
    f"""with {OBS}, base as (select distinct incident_id, value from obs where dimension = 'activity'),
    others as (select distinct incident_id, dimension as kind, value as item from obs where dimension <> 'activity'
      union select distinct incident_id, 'rule', rule from obs where dimension = 'barrier' and rule is not null),
    items as (select value, kind, item, count(*) as n from base join others using (incident_id) group by 1, 2, 3),
    r as (select *, row_number() over (partition by value, kind order by n desc, item) as rn from items),
    tops as (select value, string_agg(item || '=' || n, ';' order by rn) filter (kind = 'location' and rn <= 4) as tl,
      string_agg(item || '=' || n, ';' order by rn) filter (kind = 'barrier' and rn <= 4) as tb,
      string_agg(item || '=' || n, ';' order by rn) filter (kind = 'rule' and rn <= 4) as tr from r group by 1),
    act as (select count(distinct incident_id) as n from base)
    select row_number() over (order by incidents desc, value) as rank, value, incidents, psif_linked,
      {pct_sql("incidents", "n")} as share, {RATE}, incidents >= 2 as recurring, tl as top_locations, tb as top_barriers,
      tr as top_rules from cnt left join tops using (value), act where dimension = 'activity'""",
)
def _(t):
    out = p.activity_view(obs(t))
    return out.withColumns({c: listed(c) for c in ("top_locations", "top_barriers", "top_rules")})


@query(
    "g18_barrier_view",
    f"""with {OBS} select row_number() over (order by incidents desc, deficient desc, value) as rank, value, incidents,
      effective, deficient, psif_linked, {pct_sql("incidents", "n")} as share, {RATE}
      from cnt, total where dimension = 'barrier'""",
)
def _(t):
    return p.barrier_view(obs(t))


@query(
    "g18_barrier_callouts",
    f"""with {OBS}, l as (select value, unnest(['frequent','effective','deficient']) as callout,
        unnest([incidents, effective, deficient]) as n from cnt where dimension = 'barrier')
    select callout, value, n from l where n > 0 qualify row_number() over (partition by callout order by n desc, value) = 1""",
)
def _(t):
    return p.barrier_callouts(obs(t))


PATHS = """acts as (select distinct incident_id, value as activity, psif_state from obs where dimension = 'activity'
    and value not in ('UNKNOWN ACTIVITY', 'UNKNOWN LOCATION')),
  locs as (select distinct incident_id, value as place from obs where dimension = 'location' and value <> 'UNKNOWN LOCATION'),
  bars as (select distinct incident_id, value as barrier from obs where dimension = 'barrier'
    and control_state in ('ABSENT', 'FAILED')),
  paths as (select activity, place as location, coalesce(barrier, '—') as barrier,
    case when psif_state = 'PSIF' then 'PSIF Candidate' else 'Non-PSIF' end as outcome, count(*) as incidents
    from acts join locs using (incident_id) left join bars using (incident_id) group by 1, 2, 3, 4)"""


@query("j8_pathways", f"with {OBS}, {PATHS} select * from paths")
def _(t):
    return p.pathways(obs(t))


@query(
    "g19_top_pathways",
    f"""with {OBS}, {PATHS} select paths.*, row_number() over (order by incidents desc, activity, location, barrier, outcome)
      as rank, {pct_sql("incidents", "n")} as share from paths, total order by rank limit 3""",
)
def _(t):
    return p.top_pathways(obs(t))


@query(
    "g20_pattern_summary",
    f"""with {OBS} select dimension, count(*) as "values", count(*) filter (incidents >= 2) as recurring from cnt group by 1""",
)
def _(t):
    return p.pattern_summary(obs(t))
