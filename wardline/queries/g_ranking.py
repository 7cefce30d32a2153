"""Joins, ranking and set operations."""

from pyspark.sql import functions as F

from wardline.operators import ranking as r
from wardline.plans.scale import first_k, ranked, total
from wardline.functions.codes import percent
from wardline.queries.b_filters import SCORED, queue_tables
from wardline.queries.registry import query
from wardline.queries.sqltext import pct_sql


@query(
    "j1_left_outer",
    f"""with {SCORED} select c.conv_id, c.turn, s.site, s.score from conversations c
      left join scored s on c.conv_id * 7 = s.incident_id""",
)
def _(t):
    conv = t.conversations.select("conv_id", "turn", (F.col("conv_id") * 7).alias("incident_id"))
    return conv.join(t.scored().select("incident_id", "site", "score"), "incident_id", "left").drop("incident_id")


@query("j3_semi", "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 49)")
def _(t):
    big = t.lineitem.filter(F.col("l_quantity") > 49).select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(big, "o_orderkey", "left_semi")


@query("j4_anti", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def _(t):
    keys = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return r.not_selected(t.orders.select("o_orderkey"), keys, ["o_orderkey"])


@query(
    "j6_two_reviewers",
    """with l as (select conv_id, role, turn, md5(text) as m from conversations
        qualify row_number() over (partition by conv_id, role order by turn desc) = 1)
    select a.conv_id, a.turn as turn_a, b.turn as turn_b, a.m = b.m as same from l a join l b using (conv_id)
    where a.role = 'user' and b.role = 'assistant'""",
)
def _(t):
    rows = t.conversations.select("conv_id", "role", "turn", F.md5("text").alias("m"))
    last = r.latest_per(rows, ["conv_id", "role"], ["turn"])
    pair = lambda role, name: F.max(F.when(F.col("role") == role, F.struct("turn", "m"))).alias(name)
    both = last.groupBy("conv_id").agg(pair("user", "a"), pair("assistant", "b"))
    return both.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select(
        "conv_id", F.col("a.turn").alias("turn_a"), F.col("b.turn").alias("turn_b"), (F.col("a.m") == F.col("b.m")).alias("same")
    )


@query(
    "w1_rank",
    """select c_nationkey, count(*) as n, row_number() over (order by count(*) desc, c_nationkey) as rank
      from customer group by 1""",
)
def _(t):
    counts = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, [F.col("n").desc(), F.col("c_nationkey").asc()])


@query(
    "w3_latest_row",
    """select conv_id, role, turn, md5(text) as m from conversations
      qualify row_number() over (partition by conv_id, role order by turn desc) = 1""",
)
def _(t):
    rows = t.conversations.select("conv_id", "role", "turn", F.md5("text").alias("m"))
    return r.latest_per(rows, ["conv_id", "role"], ["turn"])


QUEUE = f"""{SCORED}, q as (select s.incident_id, s.score, predicted, date '2024-01-01' + (s.incident_id % 365)::int as day,
  case s.incident_id % 4 when 0 then 'Weak' when 1 then 'Moderate' else 'Strong' end as strength,
  s.incident_id % 3 <> 0 as unrev, case when quality <> toxic then 'THREE_WAY_DISAGREEMENT'
    when quality is not null then 'ALL_AGREE' end as ag
  from scored s left join labels on doc_id = s.incident_id)"""
ORDERS = {
    "priority": """case when ag = 'THREE_WAY_DISAGREEMENT' then 1 when predicted and strength = 'Weak' then 2
      when predicted and unrev then 3 when unrev then 4 else 5 end, score desc, day desc, incident_id""",
    "newest": "day desc, incident_id",
    "weak_evidence": "case strength when 'Weak' then 1 when 'Moderate' then 2 else 3 end, score desc, day desc, incident_id",
    "disagreement": """case when ag = 'THREE_WAY_DISAGREEMENT' then 1 when ag is not null then 2 else 3 end, day desc,
      incident_id""",
    "unreviewed": "case when unrev then 1 else 2 end, score desc, day desc, incident_id",
}


def queue_query(mode):
    @query(
        f"w4_queue_{mode}",
        f"""with {QUEUE} select incident_id, row_number() over (order by {ORDERS[mode]}) as rank from q
          qualify rank <= 40""",
    )
    def _(t):
        base, preds, _, reviews, _ = queue_tables(t)
        rows = base.join(preds, "incident_id", "left").join(reviews, "incident_id", "left")
        return first_k(rows, 40, r.queue_order(mode)).select("incident_id", "rank")


for _mode in ORDERS:
    queue_query(_mode)


@query(
    "w5_share_of_total",
    f"""with n as (select o_orderpriority, count(*) as n from orders group by 1), t as (select sum(n) as s, max(n) as m from n)
    select o_orderpriority, n, {pct_sql("n", "s")} as share, {pct_sql("n", "m")} as of_peak from n, t""",
)
def _(t):
    counts = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns({
        "share": percent(F.col("n"), total(counts, F.sum("n"))),
        "of_peak": percent(F.col("n"), total(counts, F.max("n"))),
    })


@query("w6_global_top_k", """select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as rank
  from orders order by rank limit 25""")
def _(t):
    return first_k(t.orders.select("o_orderkey", "o_totalprice"), 25, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


@query(
    "x1_union_precedence",
    """with u as (select doc_id as id, 'label' as origin, 0 as source_rank from labels union all
      select user_id * 3, 'event', 1 from events union all select doc_id, 'document', 2 from documents)
    select id, source_rank, min(origin) as origin from u qualify row_number() over (partition by id order by source_rank) = 1
    """.replace("select id, source_rank, min(origin) as origin from u qualify", "select distinct id, source_rank, origin from u qualify"),
)
def _(t):
    a = t.labels.select(F.col("doc_id").alias("id"), F.lit("label").alias("origin"))
    b = t.events.select((F.col("user_id") * 3).alias("id"), F.lit("event").alias("origin"))
    c = t.documents.select(F.col("doc_id").alias("id"), F.lit("document").alias("origin"))
    return r.union_by_precedence([a, b, c], "id")


@query(
    "x2_shared_values",
    """select o_custkey from orders where o_orderstatus in ('F', 'O', 'P') group by 1
      having count(distinct o_orderstatus) = 3""",
)
def _(t):
    return r.shared_values(t.orders, "o_orderstatus", "o_custkey", ["F", "O", "P"])


@query("x3_not_selected", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def _(t):
    return r.not_selected(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])
