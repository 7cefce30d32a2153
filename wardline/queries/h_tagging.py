"""Entity resolution and tagging over texts, with keyword tables whose words occur in them."""

from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.operators import entities as e
from wardline.operators import lookup
from wardline.operators import tagging as g
from wardline.queries.registry import query
from wardline.queries.sqltext import WS, lines_sql, quote, ratio_sql, span_sql, values_sql
from wardline.rules.entities import TAXONOMIES, UNKNOWN_MARKERS, Taxonomy

def key_sql(column):
    cleaned = f"regexp_replace(lower(coalesce({column}, '')), '[_\\-/\\\\.,;:()\\[\\]{{}}&+#%*]+', ' ', 'g')"
    return f"trim(regexp_replace({cleaned}, '{WS}+', ' ', 'g'))"


@query("e1_lookup_key", f"select url, {key_sql('url')} as key from pages")
def _(t):
    return t.pages.select("url", tx.lookup_key("url").alias("key"))


MARKERS = ", ".join(quote(m) for m in ("", *UNKNOWN_MARKERS))
RAW = """case o_orderkey % 5 when 0 then 'N/A' when 1 then o_orderpriority when 2 then 'Not-Specified' when 3 then null
  else o_orderstatus end"""


def raw_value():
    r = F.col("o_orderkey") % 5
    return (
        F.when(r == 0, "N/A").when(r == 1, F.col("o_orderpriority")).when(r == 2, "Not-Specified")
        .when(r == 4, F.col("o_orderstatus"))
    )


@query("e2_is_unknown", f"select o_orderkey, {key_sql(RAW)} in ({MARKERS}) as unknown from orders")
def _(t):
    return t.orders.select("o_orderkey", e.is_unknown(tx.lookup_key(raw_value())).alias("unknown"))


SEGMENTS = Taxonomy(
    "segment", ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "MACHINERX", "Household Goods"),
    {"house hold": "Household Goods", "cars": "AUTOMOBILE"},
)
SEG_RAW = """case c_custkey % 8 when 0 then c_mktsegment when 1 then lower(c_mktsegment) when 2 then 'House-Hold'
  when 3 then replace(c_mktsegment, 'M', 'N') when 4 then 'unspecified' when 5 then c_mktsegment || 's'
  when 6 then null else c_name end"""


def segments(t):
    r = F.col("c_custkey") % 8
    seg = F.col("c_mktsegment")
    raw = (
        F.when(r == 0, seg).when(r == 1, F.lower(seg)).when(r == 2, "House-Hold")
        .when(r == 3, F.replace(seg, F.lit("M"), F.lit("N"))).when(r == 4, "unspecified")
        .when(r == 5, F.concat(seg, F.lit("s"))).when(r == 7, F.col("c_name"))
    )
    return t.customer.select("c_custkey", raw.alias("raw"))


CANON = values_sql([(c, e._key(c)) for c in SEGMENTS.canonical])
ALIAS = values_sql(list(SEGMENTS.aliases.items()))
RESOLVE = f"""with canon(canonical, k) as (values {CANON}), alias(k, canonical) as (values {ALIAS}),
  v as (select c_custkey, raw, {key_sql('raw')} as key from (select c_custkey, {SEG_RAW} as raw from customer)),
  sim as (select v.c_custkey, c.canonical, greatest(length(key), length(c.k)) as len,
    levenshtein(key, c.k) as lev from v join canon c on length(key) >= 4),
  ok as (select *, (len - lev) / len::double as s from sim where (len - lev) * 100 >= 88 * len),
  top as (select *, max(s) over (partition by c_custkey) as m from ok),
  near as (select c_custkey, count(*) as n, arg_max(canonical, s) as canonical, max(len - lev) as num, arg_max(len, s) as den
    from top where s >= m - 0.03 - 1e-9 group by 1)
  select v.c_custkey,
    case when key in ({MARKERS}) then '' when c.k is not null then c.canonical when a.k is not null then a.canonical
      when n = 1 then near.canonical else raw end as canonical,
    case when key in ({MARKERS}) then 'UNKNOWN' when c.k is not null then 'CANONICAL' when a.k is not null then 'MAPPED'
      when n = 1 then 'SUGGESTED' else 'UNCERTAIN' end as status,
    case when key in ({MARKERS}) then 0.0 when c.k is not null or a.k is not null then 1.0
      when n >= 1 then {ratio_sql("num", "den", 2)} else 0.5 end::double as confidence
  from v left join canon c on c.k = v.key left join alias a on a.k = v.key left join near using (c_custkey)"""


@query("e3_resolve_entity", RESOLVE)
def _(t):
    out = e.resolve_entity(segments(t), "raw", SEGMENTS)
    return out.select("c_custkey", "raw_entity.canonical", "raw_entity.status", "raw_entity.confidence")


PARTS = Taxonomy("part", ("Ring", "Widget", "Steel Bolt"), {"small ring": "Tiny Ring", "red": "Red Thing"}, containment=True)


@query(
    "e3_resolve_containment",
    """with v as (select p_partkey, lower(p_name) || ' CP-' || p_partkey as raw from part), k as (
        select *, ' ' || replace(lower(raw), '-', ' ') || ' ' as f from v),
    c(name, target, ord) as (values ('ring', 'Ring', 0), ('widget', 'Widget', 1), ('steel bolt', 'Steel Bolt', 2),
      ('small ring', 'Tiny Ring', 3), ('red', 'Red Thing', 4)),
    h as (select p_partkey, target from k join c on contains(f, ' ' || name || ' ')
      qualify row_number() over (partition by p_partkey order by length(name) desc, ord) = 1)
    select v.p_partkey, coalesce(target, raw) as canonical, case when target is null then 0.5 else 0.98 end::double
      as confidence from v left join h using (p_partkey)""",
)
def _(t):
    raw = F.concat(F.lower("p_name"), F.lit(" CP-"), F.col("p_partkey").cast("string"))
    out = e.resolve_entity(t.part.select("p_partkey", raw.alias("raw")), "raw", PARTS)
    return out.select("p_partkey", "raw_entity.canonical", "raw_entity.confidence")


@query(
    "e4_taxonomy",
    f"""with a(alias, canonical) as (values {values_sql([*((e._key(c), c) for c in SEGMENTS.canonical), *SEGMENTS.aliases.items()])})
      select canonical, alias, count(*) as customers from customer join a on alias = lower(c_mktsegment) group by 1, 2""",
)
def _(t):
    table = e.taxonomy_df(t.spark, SEGMENTS)
    keyed = t.customer.select(tx.lookup_key("c_mktsegment").alias("alias"))
    return keyed.join(table, "alias").groupBy("canonical", "alias").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "e5_asset_tag",
    """select p_partkey, case when p_partkey % 3 > 0 then 'CP-' || p_partkey end as tag from part""",
)
def _(t):
    text = F.concat("p_name", F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit(" (cp-"), F.col("p_partkey").cast("string"), F.lit(")")))
                    .otherwise(F.lit(" cp-x")))
    return t.part.select("p_partkey", e.asset_tag(text).alias("tag"))


NATIONS = Taxonomy("site", tuple(f"NATION {i}" for i in range(5)), {f"nation {i}": f"NATION {i}" for i in range(5)}, unknown="UNKNOWN")


@query(
    "e6_resolve_first",
    """select c_custkey, case when c_nationkey < 3 and c_custkey % 2 = 0 then 'NATION ' || c_nationkey
        when c_custkey % 7 < 5 then 'NATION ' || (c_custkey % 7) else 'UNKNOWN' end as site,
      case when c_nationkey < 3 and c_custkey % 2 = 0 then 'region' when c_custkey % 7 < 5 then 'location' end as site_field
      from customer""",
)
def _(t):
    df = t.customer.select(
        "c_custkey",
        F.when((F.col("c_nationkey") < 3) & (F.col("c_custkey") % 2 == 0), F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))).alias("region"),
        F.concat(F.lit("Nation-"), (F.col("c_custkey") % 7).cast("string")).alias("location"),
    )
    return e.resolve_first(df, ["region", "location"], NATIONS).select("c_custkey", "site", "site_field")


@query(
    "e7_normalize_entities",
    f"""with r as ({RESOLVE}) select c_custkey, r.canonical as segment, case when c_nationkey < 5
      then 'NATION ' || c_nationkey else 'NATION_' || c_nationkey end as site, case when c_nationkey < 5 then 'CANONICAL'
      else 'UNCERTAIN' end as site_status from r join customer using (c_custkey)""",
)
def _(t):
    df = segments(t).join(t.customer.select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("place")), "c_custkey")
    strict = Taxonomy("site", NATIONS.canonical, unknown="UNKNOWN")
    out = e.normalize_entities(df, {"raw": SEGMENTS, "place": strict})
    # one-digit edits of a short name look alike; keep exact hits and identities apart
    status = F.when(F.col("place_entity.status") == "CANONICAL", "CANONICAL").otherwise("UNCERTAIN")
    site = F.when(F.col("place_entity.status") == "CANONICAL", F.col("place_entity.canonical")).otherwise(F.col("place"))
    return out.select("c_custkey", F.col("raw_entity.canonical").alias("segment"), site.alias("site"), status.alias("site_status"))


KEYWORDS = {
    "Alpha": (r"the", r"th[a-z]*", r"ion"),
    "Beta": (r"que", r"ent[a-z]*", r"la"),
    "Gamma": (r"of the", r"er(?:es|ing)?", r"st[a-z]*"),
}
EDGE = r"[^\pL\pM\p{Nd}\p{Nl}\p{Pc}]"


@query(
    "e8_tag_rules",
    f"""with d as materialized (select doc_id, lower(text) as low,
      list_distinct(regexp_split_to_array(lower(text), '{EDGE}+')) as ws from documents),
    w as (select doc_id, unnest(ws) as w from d),
    u as ({" union ".join(f"select doc_id, '{r}' as rule, w from w where regexp_full_match(w, '{k}')"
                           for r, ks in KEYWORDS.items() for k in ks if " " not in k)}
      union select doc_id, 'Gamma', 'of the' from d where regexp_matches(low, '(?:^|{EDGE})of the(?:{EDGE}|$)'))
    select doc_id, rule, string_agg(w, ',' order by w) as keywords, 'narrative' as fields from u group by 1, 2""",
)
def _(t):
    out = g.tag_rules(t.documents, "doc_id", {"narrative": "text"}, KEYWORDS, contexts=False)
    return out.select(
        "doc_id", "rule", F.array_join("keywords", ",").alias("keywords"), F.array_join("fields", ",").alias("fields")
    )


@query("e8_tag_rules_contexts")
def _(t):
    """Two fields, one of them corrective; contexts as in safety reports (no SQL twin: look-behind)."""
    df = t.documents.select("doc_id", "text", F.concat_ws(" ", "source", F.lit("the"), "lang").alias("fix"))
    out = g.tag_rules(df, "doc_id", {"description": "text", "corrective_actions": "fix"}, KEYWORDS)
    return out.groupBy("rule", "match_type", "strength").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e9_dedupe_tags",
    "select distinct l_orderkey as incident_id, l_returnflag as rule, 'v' || l_linestatus as version from lineitem",
)
def _(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("incident_id"), F.col("l_returnflag").alias("rule"),
        F.concat(F.lit("v"), F.col("l_linestatus")).alias("version"),
    )
    return g.dedupe_tags(rows)


CONCEPTS = (
    ("fire", "SYNONYM", ("tionen", "thion", "the")), ("fire", "EFFECTIVE_CUE", ("er in", "and the")),
    ("water", "SYNONYM", ("eau", "que")), ("water", "EXPOSURE_CUE", ("zzz", "el la")),
)


@query(
    "e13_find_concepts",
    f"""with c(concept, cue_class, cue, ord) as (values {values_sql([(a, b, w, i) for a, b, ws in CONCEPTS for i, w in enumerate(ws)])})
      select doc_id, concept, cue_class, cue from documents join c on contains(lower(text), cue)
      qualify row_number() over (partition by doc_id, concept, cue_class order by ord) = 1""",
)
def _(t):
    return g.find_concepts(t.documents, "doc_id", "text", CONCEPTS)


TEMPORAL = (("BEFORE", "VERIFIED", True, ("er in", "the")), ("AFTER", "PLANNED", False, ("que le", "tion", "is th")))


@query(
    "e14_find_temporal",
    f"""with c(cue, phase, role, now) as (values {values_sql([(w, p, r, n) for p, r, n, ws in TEMPORAL for w in ws])})
      select doc_id, cue, phase, role, now as contemporaneous from documents join c on contains(lower(text), cue)""",
)
def _(t):
    return g.find_temporal(t.documents, "doc_id", "text", TEMPORAL)


@query("e15_first_span", f"""with l as materialized (select doc_id, {lines_sql('text')} as l from documents)
  select doc_id, {span_sql('l', 'tion[a-z]+ the|ent [a-z]+ la')} as span from l""")
def _(t):
    lines = tx.add_lines(t.documents, "text")
    return lines.select("doc_id", tx.first_span("_lines", [r"tion[a-z]+\s+the", r"ent\s+[a-z]+\s+la"], low="_guard").alias("span"))


@query(
    "e16_spans",
    f"""with l as materialized (select doc_id, {lines_sql('text')} as l from documents),
    s as (select doc_id, unnest(regexp_extract_all(l, '(?im)^.*?(?:tion|que).*$', 0)) as s,
      generate_subscripts(regexp_extract_all(l, '(?im)^.*?(?:tion|que).*$', 0), 1) as i from l),
    c as (select doc_id, case when length(s) > 120 then s[1:117] || '...' else s end as s, i from s),
    f as (select doc_id, s, min(i) as i from c group by 1, 2),
    r as (select *, row_number() over (partition by doc_id order by i) as rn from f)
    select doc_id, coalesce(string_agg(s, '|' order by rn) filter (rn <= 3), '') as spans from documents left join r using (doc_id)
    group by 1""",
)
def _(t):
    lines = tx.add_lines(t.documents, "text")
    return lines.select("doc_id", F.array_join(tx.spans("_lines", ["tion", "que"], 3, low="_guard"), "|").alias("spans"))


PREC = {"P1": ("HIGH", ("tion", "er in", "the th")), "P2": ("CRITICAL", ("eau", "que le")), "P3": ("HIGH", ("zzzz",))}


@query(
    "e17_keyword_tags",
    f"""with c(class, severity, kw, ord) as (values {values_sql([(n, s, w, i) for n, (s, ws) in PREC.items() for i, w in enumerate(ws)])})
      select doc_id, class, severity, string_agg(kw, ',' order by ord) as keywords from documents
      join c on contains(lower(text), kw) group by 1, 2, 3""",
)
def _(t):
    out = g.keyword_tags(t.documents, "doc_id", "text", PREC)
    return out.withColumn("keywords", F.array_join("keywords", ","))


@query(
    "j7_rule_lookup",
    f"""with c(class, severity, kw, ord) as (values {values_sql([(n, s, w, i) for n, (s, ws) in PREC.items() for i, w in enumerate(ws)])})
      select source, class, count(distinct doc_id) as reports from documents join c on contains(lower(text), kw) group by 1, 2""",
)
def _(t):
    tags = g.keyword_tags(t.documents, "doc_id", "text", PREC).select("doc_id", "class")
    return tags.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source", "class").agg(
        F.count(F.lit(1)).alias("reports")
    )


PHRASES = ((r"tion\s+the", "Tion missing"), (r"(?:que|la)\s+le", "Que bypassed"))


@query(
    "e18_failure_phrases",
    """with s as (select doc_id, text, unnest(regexp_split_to_array(text, '[.\\n]')) as s,
        generate_subscripts(regexp_split_to_array(text, '[.\\n]'), 1) as i from documents),
    a as (select doc_id, trim(s) as s, i from s where
        (contains(lower(trim(s)), 'ion is') or contains(lower(trim(s)), 'entre '))
      union all select doc_id, 'Tion missing', -2 from documents where regexp_matches(lower(text), 'tion\\s+the')
      union all select doc_id, 'Que bypassed', -1 from documents where regexp_matches(lower(text), '(?:que|la)\\s+le')),
    f as (select * from a qualify row_number() over (partition by doc_id, lower(s) order by i) = 1)
    select doc_id, coalesce(string_agg(s, '|' order by i), 'None detected') as phrases from documents left join f using (doc_id)
    group by 1""",
)
def _(t):
    out = g.failure_phrases(t.documents, "doc_id", "text", PHRASES, ("ion is", "entre "))
    return out.withColumn("phrases", F.array_join("phrases", "|"))


BEST = {"A": ("tion", "the", "zzz"), "B": ("que", "eau", "entre"), "C": ("er in", "of ", "la ")}


@query(
    "e19_best_class",
    """with s as (select doc_id, unnest(['A', 'B', 'C']) as class, unnest([1, 2, 3]) as ord, unnest([
        contains(lower(text), 'tion')::int + contains(lower(text), 'the')::int + contains(lower(text), 'zzz')::int,
        contains(lower(text), 'que')::int + contains(lower(text), 'eau')::int + contains(lower(text), 'entre')::int,
        contains(lower(text), 'er in')::int + contains(lower(text), 'of ')::int + contains(lower(text), 'la ')::int]) as n
      from documents)
    select doc_id, case when n > 0 then class else 'Unclassified' end as class, n::bigint as score from s
    qualify row_number() over (partition by doc_id order by n desc, ord) = 1""",
)
def _(t):
    return g.best_class(t.documents, "doc_id", "text", BEST)


__all__ = ["TAXONOMIES"]


# A taxonomy as a table: a name per part, four spellings each.
NAMES = """select 'asset' as entity_type, canonical, alias, is_canonical, p_partkey as position from (
    select p_partkey, p_name || ' unit ' || p_partkey as canonical, p_name || ' unit ' || p_partkey as alias, true as is_canonical from part
    union all select p_partkey, p_name || ' unit ' || p_partkey, 'pt ' || k || ' ' || p_partkey, false from part, (values (0), (1), (2), (3)) ks(k))"""
RAWS = """case l_orderkey % 8 when 0 then upper(p_name) || ' Unit-' || l_partkey when 1 then 'PT_' || (l_orderkey // 8 % 4) || '/' || l_partkey
  when 2 then 'repair of ' || p_name || ' unit ' || l_partkey || ' (done)' when 3 then p_name || ' nit ' || l_partkey
  when 4 then p_name || ' xunity ' || l_partkey when 5 then 'unspecified' when 6 then null else 'Order ' || l_orderkey end"""


def part_names(t):
    name = F.concat("p_name", F.lit(" unit "), F.col("p_partkey").cast("string"))
    spellings = F.array(F.struct(name.alias("alias"), F.lit(True).alias("is_canonical")), *[
        F.struct(F.concat(F.lit(f"pt {k} "), F.col("p_partkey").cast("string")).alias("alias"), F.lit(False).alias("is_canonical")) for k in range(4)])
    return t.part.select(F.lit("asset").alias("entity_type"), name.alias("canonical"), F.inline(spellings), F.col("p_partkey").alias("position"))


def part_values(t):
    r, part = F.col("l_orderkey") % 8, F.col("l_partkey").cast("string")
    raw = (
        F.when(r == 0, F.concat(F.upper("p_name"), F.lit(" Unit-"), part))
        .when(r == 1, F.concat(F.lit("PT_"), F.expr("cast(l_orderkey div 8 % 4 as string)"), F.lit("/"), part))
        .when(r == 2, F.concat(F.lit("repair of "), "p_name", F.lit(" unit "), part, F.lit(" (done)")))
        .when(r == 3, F.concat("p_name", F.lit(" nit "), part)).when(r == 4, F.concat("p_name", F.lit(" xunity "), part))
        .when(r == 5, "unspecified").when(r == 7, F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")))
    )
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))


@query(
    "e3_resolve_by_table",
    f"""with names as materialized ({NAMES}),
    v as materialized (select l_orderkey, l_linenumber, l_partkey, raw, {key_sql('raw')} as key
      from (select l_orderkey, l_linenumber, l_partkey, {RAWS} as raw from lineitem join part on l_partkey = p_partkey)),
    keys as materialized (select distinct key from v where key not in ({MARKERS})),
    whole as (select key, arg_min(canonical, (not is_canonical, position)) as canonical, not bool_or(is_canonical) as spelled
      from keys join names on alias = key group by 1),
    rest as materialized (select key from keys anti join whole using (key)),
    inside as materialized (select key, arg_min(canonical, (-length(alias), not is_canonical, position)) as canonical
      from (select key, unnest(list_distinct(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(i, len(w) + 1),
        lambda j: array_to_string(w[i:j], ' ')))))) as alias from (select key, string_split(key, ' ') as w from rest)) join names using (alias) group by 1),
    sim as (select key, canonical, greatest(length(key), length(alias)) as len, levenshtein(key, alias) as lev
      from (select key from rest anti join inside using (key)) join names on is_canonical and length(key) >= 4 and abs(length(key) - length(alias)) <= 4),
    ok as (select *, (len - lev) / len::double as s from sim where (len - lev) * 100 >= 88 * len),
    near as (select key, count(*) as n, max_by(canonical, (s, canonical)) as canonical, max(len - lev) as num, max_by(len, (s, canonical)) as den
      from (select *, max(s) over (partition by key) as m from ok) where s >= m - 0.03 - 1e-9 group by 1)
    select l_orderkey, l_linenumber, l_partkey,
      case when v.key in ({MARKERS}) then '' when w.key is not null then w.canonical when i.key is not null then i.canonical
        when n = 1 then near.canonical else raw end as canonical,
      case when v.key in ({MARKERS}) then 'UNKNOWN' when w.key is not null then case when spelled then 'MAPPED' else 'CANONICAL' end
        when i.key is not null then 'MAPPED' when n = 1 then 'SUGGESTED' else 'UNCERTAIN' end as status
    from v left join whole w on w.key = v.key left join inside i on i.key = v.key left join near on near.key = v.key""",
)
def _(t):
    out = lookup.resolve_by_table(part_values(t), {"raw": "asset"}, part_names(t), containment=["asset"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "raw_entity.canonical", "raw_entity.status")


@query(
    "e6_resolve_first_by_table",
    """select c_custkey, case when c_nationkey < 20 and c_custkey % 3 > 0 then 'NATION_' || c_nationkey else 'UNKNOWN' end as site,
      case when c_nationkey < 20 and c_custkey % 3 = 1 then 'region' when c_nationkey < 20 and c_custkey % 3 = 2 then 'location' end as site_field
      from customer""",
)
def _(t):
    table = lookup.load_taxonomy(t.nation.filter("n_nationkey < 20").withColumn("short", F.concat(F.lit("n/"), F.col("n_nationkey").cast("string"))), "site", "n_name", "short", "n_nationkey")
    nation, r = F.col("c_nationkey").cast("string"), F.col("c_custkey") % 3
    df = t.customer.select(
        "c_custkey", F.when(r == 1, F.concat(F.lit("Nation "), nation)).alias("region"), F.when(r == 2, F.concat(F.lit("N-"), nation)).alias("location"))
    return lookup.resolve_first_by_table(df, ["region", "location"], "site", table).select("c_custkey", "site", "site_field")
