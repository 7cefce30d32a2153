"""Cross-site and recurrence operators over orders by nation with line-item tags."""

from pyspark.sql import functions as F

from wardline.operators import crosssite as c
from wardline.operators import patterns
from wardline.operators.filters import latest_day
from wardline.queries.d_patterns import listed
from wardline.queries.e_portfolio import tags
from wardline.queries.registry import query
from wardline.queries.sqltext import pct_sql

RULES = ["A-F", "N-F", "N-O", "R-F", "Z-Z"]


def base(t):
    return t.dated().withColumn("site", F.when(F.col("incident_id") % 17 > 0, F.col("site")))


def facts(t):
    df = base(t).withColumn("raw_activity", F.concat_ws(" / ", "activity", "hazard"))
    return c.site_facts(df, tags(t), raw={"activity": "raw_activity"})


FACTS = """base as (select o_orderkey as incident_id, case when o_orderkey % 17 = 0 then 'UNKNOWN' else n_name end as site,
    c_mktsegment as department, o_orderpriority as activity, o_orderstatus as hazard,
    o_orderdate::date as day, o_orderkey % 7 = 0 as predicted
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
  tags as (select distinct l_orderkey as incident_id, l_returnflag || '-' || l_linestatus as rule from lineitem
    where l_linenumber > 2),
  facts as (select incident_id, site, predicted, day, 'activity' as dimension, activity as value,
      activity || ' / ' || hazard as raw_value from base
    union all select incident_id, site, predicted, day, 'hazard', hazard, hazard from base
    union all select incident_id, site, predicted, day, 'department', department, department from base
    union all select incident_id, site, predicted, day, 'rule', rule, rule from base join tags using (incident_id))"""


@query("h1_site_facts", f"with {FACTS} select site, dimension, value, count(*) as n from facts group by 1, 2, 3")
def _(t):
    return facts(t).groupBy("site", "dimension", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "h2_site_overview",
    f"""with {FACTS}, r as (select value, count(distinct site) as s from facts where dimension = 'rule' group by 1),
    a as (select count(*) as incidents, count(distinct site) filter (site <> 'UNKNOWN') as sites, count(predicted) as eligible,
      count(*) filter (predicted) as psif from base)
    select a.*, {pct_sql("psif", "eligible", 2)} as psif_rate, (select count(*) from r) as rules,
      (select count(*) from r where s >= 2) as multi_site_rules from a""",
)
def _(t):
    return c.site_overview(base(t), facts(t))


@query(
    "h3_site_comparison",
    f"""with {FACTS}, items as (select site, dimension, value, count(*) as n, row_number() over (partition by site, dimension
        order by count(*) desc, value) as rn from facts where dimension in ('rule', 'activity') group by 1, 2, 3),
    tops as (select site, string_agg(value || '=' || n, ';' order by rn) filter (dimension = 'rule' and rn <= 3) as top_rule,
      string_agg(value || '=' || n, ';' order by rn) filter (dimension = 'activity' and rn <= 3) as top_activity
      from items group by 1),
    a as (select site, site = 'UNKNOWN' as is_unknown, count(*) as incidents, count(predicted) as eligible,
      count(*) filter (predicted) as psif, count(*) filter (not predicted) as not_psif from base group by 1, 2)
    select a.*, {pct_sql("psif", "eligible")} as psif_rate, top_rule, top_activity from a left join tops using (site)""",
)
def _(t):
    out = c.site_comparison(base(t), facts(t))
    return out.withColumns({"top_rule": listed("top_rule"), "top_activity": listed("top_activity")})


@query(
    "h4_site_detail",
    f"""with {FACTS}, n as (select dimension, value, count(*) as n from facts where site = 'NATION_3' group by 1, 2),
    r as (select *, row_number() over (partition by dimension order by n desc, value) as rank from n)
    select dimension, value, n, case when dimension <> 'rule' then rank end as rank from r where dimension = 'rule' or rank <= 4""",
)
def _(t):
    return c.site_detail(facts(t), "NATION_3", 4)


@query(
    "h4_site_recent",
    f"""with {FACTS} select incident_id, day as event_date, activity,
      row_number() over (order by day desc, incident_id) as rank from base where site = 'NATION_3' order by rank limit 10""",
)
def _(t):
    out = c.site_recent(base(t), "NATION_3", "event_date")
    return out.select("incident_id", "event_date", "activity", "rank")


def wide_sql(dimension, values):
    cols = ", ".join(f"count(*) filter (value = '{v}') as \"{v}\"" for v in values)
    add = " + ".join(f"count(*) filter (value = '{v}')" for v in values)
    return f"with {FACTS} select site, {cols}, ({add})::bigint as total from facts where dimension = '{dimension}' group by 1"


@query("h5_site_rule_matrix", wide_sql("rule", RULES))
def _(t):
    return patterns.crosstab_wide(facts(t).filter(F.col("dimension") == "rule"), "site", "value", RULES)


@query("h6_site_hazard_matrix", wide_sql("hazard", ["F", "O", "P", "X"]))
def _(t):
    rows = facts(t).filter(F.col("dimension") == "hazard")
    return patterns.crosstab_wide(rows, "site", "value", ["F", "O", "P", "X"])


def cross_sql(dimension, known=None):
    names = "(select distinct value from facts where dimension = '%s')" % dimension
    if known:
        names = "(select unnest([" + ", ".join(f"'{k}'" for k in known) + "]) as value)"
    return f"""with {FACTS}, a as (select value, count(*) as incidents, count(*) filter (predicted) as psif,
        count(distinct site) as sites from facts where dimension = '{dimension}' group by 1),
      al as (select value, string_agg(raw_value, ';' order by raw_value) as aliases from
        (select distinct value, raw_value from facts where dimension = '{dimension}') group by 1),
      v as (select value, coalesce(incidents, 0) as incidents, coalesce(psif, 0) as psif, coalesce(sites, 0) as sites
        from {names} left join a using (value))
      select v.*, {pct_sql("psif", "incidents")} as psif_rate, aliases from v left join al using (value)"""


def aliased(df):
    return df.withColumn("aliases", F.array_join("aliases", ";"))


@query("h7_activities_cross_site", cross_sql("activity"))
def _(t):
    return aliased(c.cross_site(facts(t), "activity"))


@query("h8_hazards_cross_site", cross_sql("hazard", ["F", "O", "P", "X"]))
def _(t):
    return aliased(c.cross_site(facts(t), "hazard", ["F", "O", "P", "X"]))


@query("h9_rules_cross_site", cross_sql("rule", RULES))
def _(t):
    return aliased(c.cross_site(facts(t), "rule", RULES))


@query(
    "h10_compare_sites",
    f"""with {FACTS} select dimension, value, count(*) as incidents from facts where dimension in ('rule', 'activity')
      and site in ('NATION_1', 'NATION_2', 'NATION_3') group by 1, 2 having count(distinct site) = 3""",
)
def _(t):
    return c.compare_sites(facts(t), ["NATION_1", "NATION_2", "NATION_3"])


@query(
    "h11_cross_site_recurrence",
    f"""with {FACTS} select value, count(distinct site) as sites, count(*) as incidents from facts
      where dimension = 'rule' and day >= (select max(day) from base) - 180 group by 1 having count(distinct site) >= 2""",
)
def _(t):
    return c.cross_site_recurrence(facts(t), 2, 180, latest_day(t.orders, "o_orderdate"))


def tag_rows(t):
    return t.tags().withColumn("created", F.date_add("day", 3)).withColumn(
        "day", F.when(F.col("incident_id") % 6 > 0, F.col("day"))
    ).withColumns({"incident_id": F.floor(F.col("incident_id") / 2), "act": (F.col("k") % 3).cast("string")})


TAGS = """tg as (select event_id // 2 as incident_id, event_type as rule, user_id::varchar as site,
    case when event_id % 6 > 0 then ts::date end as day, (ts::date + 3) as created,
    ((props->>'$.k')::int % 3)::varchar as act from events),
  win as (select * from tg where coalesce(day, created) >= (select max(ts::date) from events) - 20)"""


@query(
    "h12_recurring",
    f"""with {TAGS}, g as (select site, act, rule, count(distinct incident_id) as occurrences, min(day) as first_seen,
        max(day) as last_seen from win group by 1, 2, 3 having count(distinct incident_id) >= 3),
    s as (select site, act, rule, string_agg(incident_id, ',' order by incident_id) as sample_ids from
      (select distinct site, act, rule, incident_id from win) group by 1, 2, 3)
    select g.*, sample_ids from g join s using (site, act, rule)""",
)
def _(t):
    out = c.recurring(
        tag_rows(t), ["site", "act", "rule"], "day", latest_day(t.events, "ts"), days=20, min_count=3, created="created"
    )
    return out.withColumn("sample_ids", F.array_join(F.col("sample_ids").cast("array<string>"), ","))


@query(
    "h13_multi_site",
    f"""with {TAGS}, t as (select rule, count(distinct site) as sites, count(distinct incident_id) as incidents,
        min(day) as first_seen, max(day) as last_seen from win where rule in ('error', 'click', 'view') group by 1
        having count(distinct site) >= 2)
    select rule, site, count(distinct incident_id) as site_incidents, any_value(sites) as sites,
      any_value(first_seen) as first_seen, any_value(last_seen) as last_seen, any_value(incidents) as incidents
    from win join t using (rule) group by 1, 2""",
)
def _(t):
    return c.multi_site(
        tag_rows(t), "rule", "site", "day", latest_day(t.events, "ts"), days=20, values=["error", "click", "view"],
        created="created",
    )
