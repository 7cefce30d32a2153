"""Large JSON array files, read by many tasks.

Spark cuts a file at every closing brace. Whether a cut lies inside a text, and how deep, depends on all that stands
before, so each fragment is measured under both assumptions and a window over one row per byte range says which one
holds. A fragment that is a whole element is parsed where it is; those of nested elements are gathered by element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.plans.scale import work_folder
from wardline.sources.quoted import LONGEST, range_states
from wardline.sources.readers import _fields, _objects

TEXT = re.compile(rb'"(?:[^"\\]|\\.)*+"', re.S)
REST = re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)  # from inside a text to its end
FRAGMENTS = "file string, block long, at long, part binary, s0 byte, s1 byte, e0 byte, e1 byte, d0 long, d1 long, f0 long, f1 long"


def measure(part: bytes, inside: bool) -> tuple[int, int]:
    """(a text is open at the end, levels gained) of a fragment and the closing brace after it."""
    if inside:
        found = REST.match(part)
        if not found:
            return 1, 0
        part = part[found.end():]
    plain = TEXT.sub(b"", part)
    cut = plain.find(b'"')
    opened = cut >= 0
    if opened:
        plain = plain[:cut]
    gained = plain.count(b"{") + plain.count(b"[") - plain.count(b"]")
    return int(opened), gained - (not opened)


def number_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the fragments of each range, in order, what holds if the range begins outside (0) or inside (1) a text:
    open text before (s) and after (e), depth before (d) and after (f) relative to the range's beginning.
    """
    key, now, depth, at = None, [0, 1], [0, 0], 0
    for batch in batches:
        files, blocks = batch.column("file"), batch.column("block")
        ends = [np.asarray(pc.run_end_encode(c).run_ends) for c in (files, blocks)] if batch.num_rows else []
        cuts = np.unique(np.concatenate(ends)).tolist() if ends else []
        for start, stop in zip([0, *cuts], cuts):
            part = batch.slice(start, stop - start)
            here = (files[start].as_py(), blocks[start].as_py())
            if here != key:
                key, now, depth = here, [0, 1], [0, 0]
            rows = []
            for text in part.column("part").to_pylist():
                found = [measure(text, bool(s)) for s in now]
                after = [d + f[1] for d, f in zip(depth, found)]
                rows.append((*now, *(f[0] for f in found), *depth, *after))
                now, depth = [f[0] for f in found], after
            table = np.array(rows, np.int64).reshape(-1, 8)
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [part.column("file"), part.column("block"), pa.array(np.arange(at, at + n)), part.column("part"),
                 *(pa.array(table[:, i].astype(np.int8)) for i in range(4)), *(pa.array(table[:, i].copy()) for i in range(4, 8))],
                ["file", "block", "at", "part", "s0", "s1", "e0", "e1", "d0", "d1", "f0", "f1"],
            )
            at += n


def elements(parts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """One row (``_t``) per element of every file's array, from numbered fragments."""
    per = parts.groupBy("file", "block").agg(
        F.max_by(F.struct("e0", "e1", F.col("f0").alias("n0"), F.col("f1").alias("n1"), "at"), "at").alias("e"),
        F.min_by(F.struct("part", "at"), "at").alias("first"),
    )
    states = range_states(per.select("file", "block", "e.e0", "e.e1", "e.n0", "e.n1"))
    edges = per.groupBy("file").agg(
        F.min_by(F.regexp_replace(F.col("first.part").cast("string"), "^\ufeff", ""), "block").rlike(r"^\s*\[").cast("int").alias("root"),
        F.max_by(F.struct("block", "e.at"), "block").alias("end"),
    )
    placed = parts.join(states.join(edges, "file"), ["file", "block"])
    inside = F.col("inside") == 1
    pick = lambda c: F.when(inside, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    last = (F.col("block") == F.col("end.block")) & (F.col("at") == F.col("end.at"))
    between = lambda s, d: (pick(s) == 0) & (F.col("offset") + pick(d) <= F.col("root"))
    placed = placed.select(
        "file", "block", "at", "part", "root", last.alias("last"), between("s", "d").alias("begins"), (between("e", "f") | last).alias("ends"),
    )
    # what closes the file stands behind the last brace; a file that is one object ends with the brace itself
    bare = F.col("last") & F.col("part").cast("string").rlike(r"(^|\])\s*$")
    text = F.concat(F.col("part").cast("string"), F.when(bare, "").otherwise("}"))
    placed = placed.select("file", "block", "at", text.alias("text"), "root", "begins", "ends", "last")
    alone = F.col("begins") & F.col("ends")
    whole = placed.filter(alone).select("text", "root", "last")
    nested = placed.filter(~alone)
    earlier = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("ends").cast("int")
    offsets = nested.groupBy("file", "block").agg(F.sum(done).alias("n")).select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")
    )
    numbered = nested.withColumn("seen", F.coalesce(F.sum(done).over(earlier), F.lit(0))).join(offsets, ["file", "block"])
    numbered = numbered.withColumn("element", F.col("seen") + F.col("skip"))
    sizes = numbered.groupBy("file", "element").agg(F.sum(F.octet_length("text")).alias("size"))
    numbered = numbered.join(sizes, ["file", "element"])
    ordered = F.array_sort(F.collect_list(F.struct("block", "at", "text")))
    stitched = numbered.filter(F.col("size") <= longest).groupBy("file", "element").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"), F.max("root").alias("root"), F.max("last").alias("last")
    )
    body = F.regexp_replace("text", "^\ufeff", "")
    body = F.when(F.col("root") == 1, F.regexp_replace(body, r"^\s*[\[,]", "")).otherwise(body)
    body = F.when(F.col("last") & (F.col("root") == 1), F.regexp_replace(body, r"\]\s*\z", "")).otherwise(body)
    rows = whole.unionByName(stitched.select("text", "root", "last")).select(body.alias("text")).filter(F.col("text").rlike(r"\S"))
    items = F.coalesce(F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>"), F.array("text"))
    broken = numbered.filter(F.col("size") > longest).select(F.col("text").alias("_t"))
    return rows.select(F.explode(items).alias("_t")).unionByName(broken)


def read_json_split(spark: SparkSession, path, columns: Sequence[str] | None = None, longest: int = LONGEST) -> DataFrame:
    """Objects of JSON array files with every value as text plus the bad-record column, from many tasks per file.

    Rows are those of ``readers.read_json``, but a broken element harms no other one as long as its quotes and
    brackets pair up. An element that is no object is a bad record; so is each fragment of an element over ``longest``
    bytes, which is what an open quote or bracket leaves behind. A file that is no array counts as one object.
    Elements that are no objects end no fragment, so a long run of them lies in one row with the next object.
    Empty files and arrays give no rows. Fragments are written once to the shared folder. Without ``columns`` the fields
    take one more pass.
    """
    source = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("part"),
    )
    folder = work_folder(spark, "json-parts")
    source.mapInArrow(number_fragments, FRAGMENTS).write.parquet(folder)
    rows = elements(spark.read.parquet(folder), longest)
    return _objects(rows, "_t", columns or _fields(rows, "_t"))
