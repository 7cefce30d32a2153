"""Compare a Spark query with its SQL twin: columns, types, row count and values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "DATE": "date", "FLOAT": "float",
}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return repr(value)


def compare(spark, con, folder, run, sql):
    """Empty string when equal, else what differs."""
    frame = run(spark, folder)
    names = sorted(frame.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in frame.collect())
    if sql is None:
        return "" if got else "no rows"
    relation = con.sql(sql)
    if sorted(relation.columns) != names:
        return f"columns {names} vs {sorted(relation.columns)}"
    left = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    right = {n: TYPES.get(str(t), str(t).lower()) for n, t in zip(relation.columns, relation.types)}
    types = {n: (left[n], right[n]) for n in names if left[n] != right[n]}
    order = [relation.columns.index(n) for n in names]
    want = sorted(tuple(plain(r[i]) for i in order) for r in relation.fetchall())
    if types:
        return f"types {types}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}: {names} {list(set(got) ^ set(want))[:4]}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(bad)} differ of {len(got)}: {names} {str(bad[0])[:1500]}"
    return "" if got else "no rows on either side"


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from wardline.session import build_session

    folder = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        folder, argv = argv[0], argv[1:]
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            message = compare(spark, con, folder, queries[name], oracles.get(name))
        except Exception as error:  # report and go on with the other queries
            message = f"{type(error).__name__}: {str(error)[:1200]}"
        bad += bool(message)
        print(f"{'FAIL' if message else 'ok  '} {name} {time.time() - start:.2f}s {'' if name in oracles else '(rows only)'} {message}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
