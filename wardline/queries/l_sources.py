"""Sources and sinks: tables written out as report files by Spark and read back, appends and upserts."""

from pyspark.sql import functions as F

from wardline.functions.codes import risk_band
from wardline.plans.pipeline import ingest
from wardline.plans.scale import work_folder
from wardline.queries.b_filters import SCORED
from wardline.queries.c_quality import CHECKED
from wardline.queries.registry import query
from wardline.queries.sqltext import quote
from wardline.rules.fields import UUID_DNS_NAMESPACE
from wardline.sources import arrays, quoted
from wardline.sources import readers as r
from wardline.sources import store
from wardline.sources import writers as w


def csv_file(t):
    """Conversations, line ends and all, as CSV files with a bad line for every 50th row and a short one for every 70th."""
    c = t.conversations
    cell = lambda x: F.concat(F.lit('"'), F.regexp_replace(x, '"', '""'), F.lit('"'))
    n = F.col("conv_id") * 100 + F.col("turn")
    line = (
        F.when(n % 50 == 0, F.concat_ws(",", F.col("conv_id").cast("string"), F.lit("x,y"), F.lit("z"), F.lit("too,many")))
        .when(n % 70 == 7, F.concat_ws(",", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
        .otherwise(F.concat_ws(",", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", cell(F.col("text"))))
    )
    folder = work_folder(t.spark, "csv")
    c.select(line.alias("value")).write.text(folder)
    return folder


FLAT = "replace(text, chr(0), '')"


@query(
    "a1_read_csv",
    f"""select conv_id::varchar as conv_id, turn::varchar as turn, case when n % 70 = 7 then null else role end as role,
      md5(case when n % 70 = 7 then null else {FLAT} end) as text from (select *, conv_id * 100 + turn as n from conversations)
      where n % 50 <> 0""",
)
def _(t):
    rows = r.good_rows(r.read_csv(t.spark, csv_file(t), ["conv_id", "turn", "role", "text"], header=False))
    return rows.withColumn("text", F.md5("text"))


@query(
    "a1_read_csv_orders",
    "select o_orderkey::varchar as key, case when o_orderkey % 3 < 2 then o_orderstatus end as status, case when o_orderkey % 3 <> 1 then o_orderpriority end as priority from orders",
)
def _(t):
    """Files whose columns come in another order, or are fewer, read together by name."""
    folder, o = work_folder(t.spark, "csv-orders"), t.orders
    names = {"key": F.col("o_orderkey").cast("string"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}
    for i, order in enumerate((("key", "status", "priority"), ("status", "key"), ("priority", "key"))):
        part = o.filter(F.col("o_orderkey") % 3 == i).select(*[names[c].alias(c) for c in order])
        part.write.option("header", True).option("quoteAll", True).csv(f"{folder}/{i}")
    return r.good_rows(r.read_csv(t.spark, f"{folder}/*", ["key", "status", "priority"]))


@query(
    "a1_read_csv_split",
    f"""select conv_id::varchar as conv_id, turn::varchar as turn, case when n % 70 = 7 then null else role end as role,
      md5(case when n % 70 = 7 then null else {FLAT} end) as text from (select *, conv_id * 100 + turn as n from conversations)
      where n % 50 <> 0""",
)
def _(t):
    """The same files, line ends in quoted cells and all, where a file may be read by many tasks."""
    rows = quoted.read_csv_split(t.spark, csv_file(t), ["conv_id", "turn", "role", "text"], header=False)
    return r.good_rows(rows).withColumn("text", F.md5("text"))


@query(
    "a1_read_csv_split_orders",
    """select o_orderkey::varchar as key, case when o_orderkey % 3 < 2 then o_orderstatus end as status,
      case when o_orderkey % 3 <> 1 then note end as note
      from (select *, o_orderpriority || chr(10) || '"' || o_orderstatus || '", ' as note from orders)""",
)
def _(t):
    """Files with their own headers, in two encodings, with quotes and line ends in their cells."""
    folder, o = work_folder(t.spark, "csv-split"), t.orders
    note = F.concat("o_orderpriority", F.lit("\n\""), "o_orderstatus", F.lit('", '))
    names = {"key": F.col("o_orderkey").cast("string"), "status": F.col("o_orderstatus"), "note": note, "préfixe": F.lit("é")}
    for i, (order, encoding) in enumerate(((("key", "status", "note"), "UTF-8"), (("status", "key", "préfixe"), "ISO-8859-1"), (("note", "key"), "UTF-8"))):
        part = o.filter(F.col("o_orderkey") % 3 == i).select(*[names[c].alias(c) for c in order])
        part.write.options(header=True, quoteAll=True, encoding=encoding, escape='"', ignoreTrailingWhiteSpace=False).csv(f"{folder}/{i}")
    return r.good_rows(quoted.read_csv_split(t.spark, f"{folder}/*", ["key", "status", "note"]))


@query(
    "a1_bad_rows",
    "select count(*) as records, count(*) filter ((conv_id * 100 + turn) % 50 = 0) as bad, 0::bigint as empty from conversations",
)
def _(t):
    return r.bad_count(r.read_csv(t.spark, csv_file(t), ["conv_id", "turn", "role", "text"], header=False))


@query(
    "a2_read_json",
    "select o_orderkey::varchar as o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 40 > 0",
)
def _(t):
    return r.good_rows(r.read_json(t.spark, json_arrays(t), ["o_orderkey", "o_orderstatus", "o_orderpriority"]))


@query(
    "a2_read_json_split",
    "select o_orderkey::varchar as o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 40 > 0",
)
def _(t):
    """The same files, where a file may be read by many tasks."""
    return r.good_rows(arrays.read_json_split(t.spark, json_arrays(t), ["o_orderkey", "o_orderstatus", "o_orderpriority"]))


def json_arrays(t):
    """Orders as array files, with numbers among the objects."""
    folder = work_folder(t.spark, "json")
    obj = F.when(F.col("o_orderkey") % 40 > 0, F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).otherwise(
        F.col("o_orderkey").cast("string")
    )
    # one array per file, numbers among the objects; about 500 elements an array, so files grow in number and not in size
    files = max(1, t.orders.count() // 500)
    group = F.pmod(F.xxhash64("o_orderkey"), F.lit(files))
    lists = t.orders.select(group.alias("g"), obj.alias("o")).groupBy("g").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("o"), ","), F.lit("]")).alias("value")
    )
    lists.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return folder


@query(
    "a3_read_jsonl",
    """select case when conv_id % 9 = 0 then null else conv_id::varchar end as conv_id, turn::varchar as turn, md5(text) as text
      from conversations where (conv_id + turn) % 25 > 0""",
)
def _(t):
    return r.good_rows(jsonl_rows(t)).withColumn("text", F.md5("text"))


@query(
    "a3_bad_rows",
    "select count(*) as records, count(*) filter ((conv_id + turn) % 25 = 0) as bad, 0::bigint as empty from conversations",
)
def _(t):
    return r.bad_count(jsonl_rows(t))


def jsonl_rows(t):
    folder = work_folder(t.spark, "jsonl")
    conv = F.when(F.col("conv_id") % 9 > 0, F.col("conv_id"))
    good = F.to_json(F.struct(conv.alias("conv_id"), "turn", "text"))
    line = F.when((F.col("conv_id") + F.col("turn")) % 25 > 0, good).otherwise(F.concat(F.lit("{broken "), F.col("turn").cast("string")))
    t.conversations.select(line.alias("value")).write.text(folder)
    return r.read_reports(t.spark, folder, "jsonl", ["conv_id", "turn", "text"])


@query("a5_preview", "select n_nationkey, n_name from nation order by n_nationkey limit 10")
def _(t):
    return r.preview(t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey"), 10)


@query("a5_row_count", "select count(*) as rows from lineitem")
def _(t):
    return r.row_count(t.lineitem)


@query(
    "a6_infer_types",
    """select unnest(['key', 'price', 'day', 'flag', 'priority', 'nothing', 'half']) as "column",
      unnest(['number', 'number', 'date', 'boolean', 'string', 'string', 'string']) as type from (select count(*) from orders)""",
)
def _(t):
    df = t.orders.select(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").cast("string").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("no").alias("flag"),
        F.col("o_orderpriority").alias("priority"), F.lit(None).cast("string").alias("nothing"),
        F.when(F.col("o_orderkey") % 2 == 0, "12").otherwise("x").alias("half"),
    )
    return r.infer_column_types(df)


UUID_SQL = f"""(select substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' ||
  substr('89ab', (strpos('0123456789abcdef', substr(h,17,1))::int - 1) % 4 + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12)
  from (select sha1(unhex('{UUID_DNS_NAMESPACE}') || (source || ':ext:' || doc_id)::blob) as h))"""


@query(
    "a7_ingest",
    f"""with {CHECKED} select doc_id, {UUID_SQL} as incident_id, lang as job_task,
      case when coalesce(chk, 'SHORT_NARRATIVE') <> 'SHORT_NARRATIVE' then 'CRITICAL' when chk is not null or doc_id % 4 = 0
        then 'WARNING' else 'VALID' end as quality_status, (words < 10) as is_sparse from checked""",
)
def _(t):
    docs = t.documents.withColumn(
        "day", F.when(F.col("doc_id") % 4 > 0, F.lit("2024-02-03")).otherwise("n/a")
    )
    mapping = {"external_id": "doc_id", "description": "text", "job_task": "lang", "location": "source", "incident_date": "day"}
    out = ingest(docs.withColumn("dataset", F.col("source")), F.col("location"), mapping, "doc_id", F.to_date(F.lit("2025-01-01")))
    return out.gated.select("doc_id", "incident_id", "job_task", "quality_status", "is_sparse")


@query(
    "a8_export_csv",
    f"""with {SCORED} select incident_id::varchar as incident_id, site, case when incident_id % 5 = 0 then 'Unknown' when score < 0.25
        then 'low' when score < 0.5 then 'medium' when score < 0.75 then 'high' else 'critical' end as risk_level,
      (incident_id % 5 > 0 and predicted)::varchar as predicted,
      printf('%.4f', case when incident_id % 5 = 0 then 0.0 else score end) as probability from scored where activity = 'en'""",
)
def _(t):
    preds = t.predictions().filter(F.col("incident_id") % 5 > 0).withColumn("risk_level", risk_band(F.col("score")))
    df = t.incidents().select("incident_id", "site", "activity")
    rows = w.export_rows(df, preds.drop("sparse"), F.col("activity") == "en").drop("activity")
    folder = work_folder(t.spark, "export")
    w.export_csv(rows, folder)
    return r.good_rows(r.read_csv(t.spark, folder, rows.columns))


@query(
    "a9_append_new",
    """select distinct o_custkey, o_orderstatus from orders where (o_custkey, o_orderstatus) not in
      (select c_custkey, 'F' from customer)""",
)
def _(t):
    have = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    return w.append_new(have, t.orders.select("o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"])


@query(
    "a10_upsert",
    """select user_id as id, 'event' as origin, count(*) as n from events group by 1
      union all select doc_id, 'document', n_chars from documents where doc_id not in (select user_id from events)""",
)
def _(t):
    new = t.events.groupBy(F.col("user_id").alias("id")).agg(F.lit("event").alias("origin"), F.count(F.lit(1)).alias("n"))
    old = t.documents.select(F.col("doc_id").alias("id"), F.lit("document").alias("origin"), F.col("n_chars").alias("n"))
    return w.upsert(old, new, ["id"])


@query("a11_backfill", "select doc_id, n_chars from documents where doc_id not in (select doc_id from labels where toxic = 0)")
def _(t):
    return w.backfill(t.documents.select("doc_id", "n_chars"), t.labels.filter("toxic = 0"), ["doc_id"])


@query("a11_backfill_forced", "select doc_id, n_chars from documents")
def _(t):
    return w.backfill(t.documents.select("doc_id", "n_chars"), t.labels, ["doc_id"], force=True)


@query(
    "a9_append_stored",
    """select o_custkey, o_orderstatus, min(o_orderkey) % 1 as n from orders group by 1, 2""",
)
def _(t):
    """Three batches and a repeat of the first; every (customer, status) is stored once."""
    path, rows = work_folder(t.spark, "a9"), t.orders.select("o_custkey", "o_orderstatus", "o_orderkey", (F.col("o_orderkey") % 1).alias("n"))
    for batch in (0, 1, 2, 0):
        store.append_batch(rows.filter(F.col("o_orderkey") % 3 == batch).drop("o_orderkey"), path, ["o_custkey", "o_orderstatus"], f"b{batch}", 16)
    return store.read_store(t.spark, path)


@query(
    "a10_replace_stored",
    """select o_custkey, arg_max(o_orderkey, (o_orderkey % 2, o_orderkey)) as o_orderkey, arg_max(o_orderstatus, (o_orderkey % 2, o_orderkey)) as o_orderstatus
      from orders group by 1""",
)
def _(t):
    """Orders with even keys, then those with odd keys in their place, then those again; each customer keeps the last order."""
    path, rows = work_folder(t.spark, "a10"), t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    for batch in (0, 1, 1):
        store.replace_batch(rows.filter(F.col("o_orderkey") % 2 == batch), path, ["o_custkey"], f"b{batch}", "o_orderkey", 16)
    return store.read_store(t.spark, path)


@query(
    "a11_backfill_stored",
    """select doc_id, case when doc_id in (select doc_id from labels) then 'first' else 'second' end as run, n_chars * 2 as score from documents""",
)
def _(t):
    """Results of the labelled documents, then of all that have none yet."""
    path, docs = work_folder(t.spark, "a11"), t.documents.select("doc_id", "n_chars")
    run = lambda name: lambda df: df.select("doc_id", F.lit(name).alias("run"), (F.col("n_chars") * 2).alias("score"))
    store.backfill_batch(docs.join(t.labels, "doc_id", "left_semi"), path, ["doc_id"], "one", run("first"), buckets=16)
    store.backfill_batch(docs, path, ["doc_id"], "two", run("second"), buckets=16)
    return store.read_store(t.spark, path)


__all__ = ["quote"]
