"""Sinks that keep a keyed table in a folder: idempotent append, replacement by key, backfill.

Rows lie in ``bucket=<hash of the key>`` partitions, so a batch reads and rewrites only the partitions its keys fall
into. Every batch has a name: it is staged, moved in by a dynamic partition overwrite (or appended), and marked when it
is in. A batch that is run again after its mark does nothing; one that broke off before it is repeated with the same
result, as its rows are matched by key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket"
BUCKETS = 64


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int").alias(BUCKET)


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null keys equal null keys."""
    on = left[keys[0]].eqNullSafe(right[keys[0]])
    for k in keys[1:]:
        on = on & left[k].eqNullSafe(right[k])
    return on


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the table without the bucket column; None before the first batch."""
    rows = _read(spark, path)
    return None if rows is None else rows.drop(BUCKET)


def is_committed(spark: SparkSession, path: str, batch: str) -> bool:
    return _read(spark, f"{path}/_batches/{batch}") is not None


def _commit(spark: SparkSession, path: str, batch: str, buckets: list[int]) -> None:
    marks = spark.createDataFrame([(batch, buckets)], "batch string, buckets array<int>").coalesce(1)
    marks.write.mode("ignore").parquet(f"{path}/_batches/{batch}")


def _stage(rows: DataFrame, path: str, batch: str, keys: Sequence[str], buckets: int, order: str | None) -> tuple[DataFrame, list[int]]:
    """The batch with one row a key, the last by ``order``, written to the staging folder, and the buckets it touches."""
    spark = rows.sparkSession
    if order:
        best = F.max_by(F.struct(*rows.columns), F.struct(order, F.xxhash64(*rows.columns))).alias("_row")
        rows = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best).select("_row.*")
    else:
        rows = rows.dropDuplicates(list(keys))
    staged = f"{path}/_staging/{batch}/rows"
    rows.select("*", _bucket(keys, buckets)).write.mode("overwrite").parquet(staged)
    staged_rows = spark.read.parquet(staged)
    touched = sorted(r[0] for r in staged_rows.select(BUCKET).distinct().collect())  # at most one number a bucket
    return staged_rows, touched


def append_batch(rows: DataFrame, path: str, keys: Sequence[str], batch: str, buckets: int = BUCKETS) -> bool:
    """Adds the rows whose key the table does not hold, one a key. False where the batch is in already."""
    spark = rows.sparkSession
    if is_committed(spark, path, batch):
        return False
    staged, touched = _stage(rows, path, batch, keys, buckets, None)
    held = _read(spark, path)
    if held is not None:
        held = held.filter(F.col(BUCKET).isin(touched)).select(*keys)
        staged = staged.join(held, _same_key(staged, held, keys), "left_anti")
    staged.write.mode("append").partitionBy(BUCKET).parquet(path)
    _commit(spark, path, batch, touched)
    return True


def replace_batch(rows: DataFrame, path: str, keys: Sequence[str], batch: str, order: str | None = None, buckets: int = BUCKETS) -> bool:
    """Puts the rows in place of those with the same key, and adds the others. False where the batch is in already.

    Of rows with one key the last by ``order`` counts (without it any). Partitions without a key of the batch are not read.
    """
    spark = rows.sparkSession
    if is_committed(spark, path, batch):
        return False
    staged, touched = _stage(rows, path, batch, keys, buckets, order)
    held, merged = _read(spark, path), staged
    if held is not None:
        held = held.filter(F.col(BUCKET).isin(touched))
        new = staged.select(*keys)
        merged = held.join(new, _same_key(held, new, keys), "left_anti").select(staged.columns).unionByName(staged)
    # staged apart, so that the partitions are complete before any of them is overwritten
    whole = f"{path}/_staging/{batch}/partitions"
    merged.write.mode("overwrite").parquet(whole)
    parts = spark.read.parquet(whole).repartition(BUCKET)
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    _commit(spark, path, batch, touched)
    return True


def backfill_batch(
    todo: DataFrame, path: str, keys: Sequence[str], batch: str, compute: Callable[[DataFrame], DataFrame], force: bool = False, buckets: int = BUCKETS
) -> bool:
    """Computes and stores the results of the rows that have none; of all rows with ``force``, in place of the old ones."""
    spark = todo.sparkSession
    if force:
        return replace_batch(compute(todo), path, keys, batch, buckets=buckets)
    held = read_store(spark, path)
    if held is not None:
        done = held.select(*keys)
        todo = todo.join(done, _same_key(todo, done, keys), "left_anti")
    return append_batch(compute(todo), path, keys, batch, buckets)
