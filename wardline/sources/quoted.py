"""Large CSV files whose quoted cells hold line ends, read by many tasks.

Spark hands out lines by byte ranges, and no task knows whether its first line lies inside a quoted cell. So every line
is numbered under both assumptions, a range says what it makes of either, and a window over one row per range picks
the one that holds. Only lines of records with line ends are gathered; all others are parsed where they are.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.plans.scale import work_folder
from wardline.sources.readers import BAD

LONGEST = 16 << 20  # bytes of one record; a longer one is a quote that nobody closed
LINES = "file string, block long, at long, line binary, ends byte, r0 long, r1 long"


def end_state(sep: str = ","):
    """A function (line, inside) -> whether a quoted cell is open after the line.

    A quote opens a cell only at the cell's beginning, two quotes inside are one letter, and what follows a closing quote
    up to the separator belongs to the cell, quotes included.
    """
    s = re.escape(sep.encode())
    cells = re.compile(rb'(?:(?:"(?:[^"]|"")*+"(?!")[^%b]*+|[^"%b][^%b]*+|)%b)*+' % (s, s, s, s))
    closing = re.compile(rb'(?:[^"]|"")*+"[^%b]*+(%b|\Z)' % (s, s))
    opened = re.compile(rb'"(?:[^"]|"")*+\Z')

    def state(line: bytes, inside: bool) -> bool:
        at = 0
        if inside:
            found = closing.match(line)
            if not found:
                return True
            at = found.end()
            if not found.group(1):
                return False
        return bool(opened.match(line, cells.match(line, at).end()))

    return state


def number_lines(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    """Adds to the lines of each range, in order, their record numbers when the range begins outside (r0) or inside (r1)
    a quoted cell. ``ends`` has four bits: open before and after the line outside, and the same inside.
    """
    state, now, key, records, at = end_state(sep), [0, 1], None, [0, 0], 0
    for batch in batches:
        files, blocks = batch.column("file"), batch.column("block")
        runs = np.asarray(pc.run_end_encode(blocks).run_ends), pc.run_end_encode(files).run_ends.to_numpy()
        cuts = np.unique(np.concatenate(runs)).tolist() if batch.num_rows else []
        for start, stop in zip([0, *cuts], cuts):
            part = batch.slice(start, stop - start)
            here = (files[start].as_py(), blocks[start].as_py())
            if here != key:
                key, now, records = here, [0, 1], [0, 0]
            lines, n = part.column("line"), part.num_rows
            quoted = np.flatnonzero(np.asarray(pc.match_substring(lines, b'"')))
            before = np.zeros((2, n + 1), np.int8)
            last = 0
            for i in quoted.tolist():
                line = lines[i].as_py()
                for p in (0, 1):
                    before[p, last : i + 1] = now[p]
                now = [int(state(line, bool(s))) for s in now]
                last = i + 1
            for p in (0, 1):
                before[p, last:] = now[p]
            numbers = [records[p] + np.cumsum(before[p, :n] == 0) for p in (0, 1)]
            records = [int(x[-1]) for x in numbers]
            ends = before[0, :n] | before[0, 1:] << 1 | before[1, :n] << 2 | before[1, 1:] << 3
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("file", "block")), pa.array(np.arange(at, at + n)), lines,
                 pa.array(ends.astype(np.int8)), *(pa.array(x.astype(np.int64)) for x in numbers)],
                ["file", "block", "at", "line", "ends", "r0", "r1"],
            )
            at += n


def _bit(i: int) -> Column:
    return F.shiftright(F.col("ends").cast("int"), i).bitwiseAND(1)


def range_states(per: DataFrame) -> DataFrame:
    """(file, block, inside, offset): how each range begins, and the sum of ``n`` over the ranges before it.

    ``per`` has a row per range: its state at the end and ``n``, if it begins outside (e0, n0) or inside (e1, n1). These
    rows alone enter the window of their file.
    """
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    swap = ((F.col("e0") == 1) & (F.col("e1") == 0)).cast("int")
    turned = per.withColumn("swaps", F.sum(swap).over(Window.partitionBy("file").orderBy("block")))
    fixed = F.when(F.col("e0") == F.col("e1"), F.struct("e0", "swaps"))  # this range ends the same way in either case
    known = turned.withColumn("fixed", F.last(fixed, ignorenulls=True).over(earlier)).withColumn(
        "so_far", F.coalesce(F.max("swaps").over(earlier), F.lit(0))
    )
    inside = (F.coalesce("fixed.e0", F.lit(0)) + F.col("so_far") - F.coalesce("fixed.swaps", F.lit(0))) % 2
    n = F.when(F.col("inside") == 1, F.col("n1")).otherwise(F.col("n0"))
    states = known.withColumn("inside", inside.cast("int"))
    return states.select("file", "block", "inside", F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("offset"))


def block_states(lines: DataFrame) -> DataFrame:
    """(file, block, inside, offset, utf8): how each range begins, the records before it, and whether its file is UTF-8."""
    per = lines.groupBy("file", "block").agg(
        F.max_by(F.struct(_bit(1).alias("e0"), _bit(3).alias("e1")), "at").alias("e"),
        F.max("r0").alias("n0"), F.max("r1").alias("n1"),
        F.min(F.is_valid_utf8(F.col("line").cast("string"))).alias("valid"),
    ).select("file", "block", "e.e0", "e.e1", "n0", "n1", "valid")
    utf8 = per.groupBy("file").agg(F.min("valid").alias("utf8"))
    return range_states(per).join(utf8, "file")


def records(lines: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(file, record, text, bad) from numbered lines; a record over ``longest`` bytes gives its lines, each marked bad."""
    # one row per range of bytes: sent to the lines, which stay where they are
    placed = lines.join(F.broadcast(block_states(lines)), ["file", "block"])
    inside = F.col("inside") == 1
    placed = placed.select(
        "file", "block", "at", "line", "utf8",
        (F.col("offset") + F.when(inside, F.col("r1")).otherwise(F.col("r0"))).alias("record"),
        F.when(inside, _bit(2) + _bit(3)).otherwise(_bit(0) + _bit(1)).alias("open"),
    )
    whole = placed.filter("open = 0").select("file", "record", "line", "utf8", F.lit(False).alias("bad"))
    parts = placed.filter("open > 0")
    sizes = parts.groupBy("file", "record").agg(F.sum(F.length("line") + 1).alias("size"))
    parts = parts.join(sizes, ["file", "record"])
    ordered = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    # bytes are joined as hex, because texts of a file that is not UTF-8 must not pass through a string
    joined = F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x["line"])), "0A"))
    stitched = parts.filter(F.col("size") <= longest).groupBy("file", "record").agg(
        joined.alias("line"), F.first("utf8").alias("utf8"), F.lit(False).alias("bad")
    )
    broken = parts.filter(F.col("size") > longest).select("file", "record", "line", "utf8", F.lit(True).alias("bad"))
    rows = whole.unionByName(stitched).unionByName(broken)
    text = F.when(F.col("utf8"), F.col("line").cast("string")).otherwise(F.decode("line", "ISO-8859-1"))
    text = F.when(text.endswith("\r"), F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\r\z", "")).otherwise(text)
    text = F.when(F.col("record") == 1, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    return rows.select("file", "record", text.alias("text"), "bad")


def read_csv_split(
    spark: SparkSession, path, columns: Sequence[str] | None = None, sep: str = ",", header: bool = True, longest: int = LONGEST,
) -> DataFrame:
    """CSV rows as strings plus the bad-record column, as ``readers.read_csv`` gives them, from many tasks per file.

    With a header each file has its own; files are put together by column name, and the driver gets one row per
    different header. Without one, ``columns`` names the cells. A file that is not UTF-8 throughout is read as
    ISO-8859-1, each file for itself. Lines end with LF or CR LF; where a record ends with CR LF, its cells have LF
    for it. Blank lines are no records. A row with too few cells has nulls, one with too many is bad. A record over ``longest`` bytes, which
    is what an open quote leaves behind, gives one bad record for each of its lines. Files without a record give
    no rows. The numbered lines are written once to the shared folder, so later steps never see other byte ranges.
    """
    if not header and not columns:
        raise ValueError("without a header give columns")
    if len(sep.encode()) != 1 or sep in '"\r\n':
        raise ValueError("a separator is one ASCII character")
    source = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )
    folder = work_folder(spark, "csv-lines")
    source.mapInArrow(lambda batches: number_lines(batches, sep), LINES).write.parquet(folder)
    rows = records(spark.read.parquet(folder), longest).filter(F.trim(F.regexp_replace("text", "[\r\n]", "")) != "")
    if not header:
        return rows.select(F.inline(_cells(F.lit(0), {0: list(columns)}, list(columns), sep)))
    # headers lie in the first range; only it is read for them
    first = records(spark.read.parquet(folder).filter("block = 0"), longest).filter("trim(text) <> '' and not bad")
    first = first.groupBy("file").agg(F.min(F.struct("record", "text")).alias("h")).select("file", F.col("h.record").alias("top"), F.col("h.text").alias("head"))
    names = {h: [c.strip() for c in next(csv.reader([h], delimiter=sep))] for (h,) in first.select("head").distinct().collect()}
    wanted = list(columns or dict.fromkeys(c for h in sorted(names) for c in names[h]))
    below = rows.join(F.broadcast(first), "file").filter(F.col("record") > F.col("top"))
    if not names:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in [*wanted, BAD]]))
    return below.select(F.inline(_cells(F.col("head"), names, wanted, sep)))


def _cells(key: Column, names: dict, wanted: list[str], sep: str) -> Column:
    """An array of one row: the wanted cells and the bad-record column, each file's text read by its own header."""
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "maxCharsPerColumn": "-1"}
    out = F.lit(None)
    for value, columns in names.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, BAD]])

        def pick(row: Column) -> Column:  # called at once
            unquoted = F.regexp_replace(row.getField(BAD), r'"(?:[^"]|"")*"', "")
            broken = F.col("bad") | (F.size(F.split(unquoted, f"[{sep}]")) > len(columns))
            cell = lambda c: F.when(~F.col("bad"), row.getField(c)) if c in columns else F.lit(None).cast("string")
            return F.struct(*[cell(c).alias(c) for c in wanted], F.when(broken, F.col("text")).alias(BAD))

        # inside the array a row is parsed once for all its cells
        parsed = F.transform(F.array(F.from_csv("text", _ddl(schema), options)), pick)
        out = F.when(key == F.lit(value), parsed).otherwise(out)
    return out


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)
