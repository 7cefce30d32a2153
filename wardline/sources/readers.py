"""Reading report files: every cell as text, bad records counted instead of failing the job."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.codes import first_date

BAD = "_bad_record"
# Spellings that make a column boolean.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0", "y", "n")


def _strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv_headers(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str = ",") -> list[tuple[tuple[str, ...], list[str]]]:
    """Files of ``path`` by the column names of their first line, in the order of their first file.

    The first lines come from the start of each file only; the driver gets one line per file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(path).select("path")
    names = sorted(r[0] for r in files.collect())
    groups: dict[tuple[str, ...], list[str]] = {}
    firsts = spark.read.option("encoding", encoding).option("wholetext", False).text(names) if names else None
    if firsts is None:
        return []
    block = F.col("_metadata.file_block_start") == 0
    lines = firsts.select(F.col("_metadata.file_path").alias("file"), F.col("value"), F.monotonically_increasing_id().alias("at"), block.alias("start"))
    first = lines.filter("start and trim(value) <> ''").groupBy("file").agg(F.min(F.struct("at", "value")).alias("l"))
    parsed = first.select("file", F.regexp_replace("l.value", "^\ufeff", "").alias("value")).collect()
    for file, value in sorted(parsed):
        cells = next(csv.reader([value], delimiter=sep))
        groups.setdefault(tuple(c.strip() for c in cells), []).append(file)
    return list(groups.items())


def read_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, encoding: str = "UTF-8", sep: str = ",",
    multiline: bool = True, header: bool = True,
) -> DataFrame:
    """CSV rows as strings plus the bad-record column; see ``good_rows``.

    With a header, files are grouped by their own header and put together by column name, so files may order their
    columns differently or lack some. ``columns`` picks the result's columns; without a header it names the cells.
    Quoted cells may hold line ends; then a file is read by one task. ``multiline=False`` splits large files and
    is right only where no cell holds a line end. A row with too few cells is kept with nulls, one with too many is bad.
    ``encoding='ISO-8859-1'`` is the fallback for files that are not UTF-8.
    """
    if not header:
        if not columns:
            raise ValueError("without a header give columns")
        return _csv_rows(spark, path, list(columns), encoding, sep, multiline, False)
    parts = [_csv_rows(spark, files, list(names), encoding, sep, multiline, True) for names, files in csv_headers(spark, path, encoding, sep)]
    if not parts:
        return spark.createDataFrame([], _strings(columns or []).add(BAD, T.StringType()))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    wanted = list(columns or [c for c in rows.columns if c != BAD])
    have = set(rows.columns)
    return rows.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in wanted], BAD)


def _csv_rows(spark: SparkSession, path, names: list[str], encoding: str, sep: str, multiline: bool, header: bool) -> DataFrame:
    reader = spark.read.schema(_strings(names).add(BAD, T.StringType())).options(
        header=header, encoding=encoding, sep=sep, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, enforceSchema=True,
        multiLine=multiline, escape='"', maxCharsPerColumn=-1,
    )
    rows = reader.csv(path)
    unquoted = F.regexp_replace(F.col(BAD), r'"(?:[^"]|"")*"', "")
    too_many = F.size(F.split(unquoted, f"[{sep}]")) > len(names)
    return rows.withColumn(BAD, F.when(too_many, F.col(BAD)))


def _objects(rows: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """JSON texts to string columns; anything but a sound object goes to the bad-record column."""
    schema = _strings(columns).add(BAD, T.StringType())
    parsed = F.from_json(F.col(text), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    out = rows.select(text, parsed.alias("_o"))
    broken = F.when(~F.col(text).rlike(r"^\s*\{") | F.col(f"_o.{BAD}").isNotNull(), F.col(text))
    return out.select(*[F.col("_o").getField(c).alias(c) for c in columns], broken.alias(BAD))


def _fields(rows: DataFrame, text: str) -> list[str]:
    """Field names of the objects: one pass, a row per different name."""
    keys = rows.select(F.explode(F.json_object_keys(text)).alias("k")).distinct().orderBy("k")
    return [r[0] for r in keys.collect()]


def read_json(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, lines: bool = False
) -> DataFrame:
    """Objects of JSON array files (or of JSON lines) with every value as text, plus the bad-record column.

    An array element that is no object is a bad record and does not harm its neighbours. Array files
    are read whole, one per task; lines split. Without ``columns`` the fields take one more pass.
    """
    if lines:
        rows = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("_t"))
    else:
        whole = spark.read.text(path, wholetext=True).withColumn("value", F.trim("value"))
        elements = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>"))
        rows = whole.select(F.explode(F.coalesce(elements, F.array("value"))).alias("_t"))
    return _objects(rows, "_t", columns or _fields(rows, "_t"))


def read_reports(
    spark: SparkSession, path: str, kind: str, columns: Sequence[str] | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    """Rows of a ``csv``, ``json`` (array) or ``jsonl`` file or folder."""
    if kind == "csv":
        return read_csv(spark, path, columns, encoding)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, columns, kind == "jsonl")
    raise ValueError(f"unknown report format {kind!r}")


def good_rows(rows: DataFrame) -> DataFrame:
    """Rows that are no bad record and not entirely empty."""
    names = [c for c in rows.columns if c != BAD]
    return rows.filter(F.col(BAD).isNull() & F.coalesce(*[F.col(f"`{c}`") for c in names]).isNotNull()).drop(BAD)


def bad_count(rows: DataFrame) -> DataFrame:
    """One row: read records, bad records, entirely empty records."""
    names = [c for c in rows.columns if c != BAD]
    empty = F.col(BAD).isNull() & F.coalesce(*[F.col(f"`{c}`") for c in names]).isNull()
    # the bad-record column alone can not be asked for, so all columns are read
    return rows.select(F.struct(*rows.columns).alias("r"), F.col(BAD).isNotNull().alias("bad"), empty.alias("empty")).agg(
        F.count("r").alias("records"), F.count_if("bad").alias("bad"), F.count_if("empty").alias("empty")
    )


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` rows."""
    return df.limit(n)


def row_count(df: DataFrame) -> DataFrame:
    """One row: exact number of rows."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def infer_column_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, type) with number, date, boolean or string, from all non-null values in one pass."""
    columns = list(columns or df.columns)

    def checks(i: int, c: str) -> list[Column]:
        value = F.trim(F.col(f"`{c}`").cast("string"))
        present = value.isNotNull() & (value != "")
        dated = first_date(value).isNotNull()
        return [
            F.count_if(present).alias(f"n{i}"),
            F.count_if(present & value.try_cast("double").isNotNull()).alias(f"number{i}"),
            F.count_if(present & dated).alias(f"date{i}"),
            F.count_if(present & F.lower(value).isin(*BOOLEAN_WORDS)).alias(f"bool{i}"),
        ]

    counts = df.agg(*[x for i, c in enumerate(columns) for x in checks(i, c)])

    def kind(i: int) -> Column:
        n = F.col(f"n{i}")
        return (
            F.when(n == 0, "string").when(F.col(f"number{i}") == n, "number").when(F.col(f"date{i}") == n, "date")
            .when(F.col(f"bool{i}") == n, "boolean").otherwise("string")
        )

    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), kind(i).alias("type")) for i, c in enumerate(columns)
    ])))
