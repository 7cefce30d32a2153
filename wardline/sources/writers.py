"""Writing results: CSV export, idempotent append, upsert and backfill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_rows(
    df: DataFrame, predictions: DataFrame, condition: Column | None = None, id_col: str = "incident_id"
) -> DataFrame:
    """Incidents with their prediction as export columns; the score has four decimals."""
    joined = df.join(predictions, id_col, "left")
    if condition is not None:
        joined = joined.filter(condition)
    return joined.select(
        *df.columns,
        F.coalesce("risk_level", F.lit("Unknown")).alias("risk_level"),
        F.coalesce("predicted", F.lit(False)).alias("predicted"),
        F.format_string("%.4f", F.coalesce("score", F.lit(0.0))).alias("probability"),
    )


def export_csv(rows: DataFrame, path: str) -> None:
    """Write rows as CSV with a header; one file per partition."""
    rows.write.mode("overwrite").options(header=True, escape='"').csv(path)


def append_new(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, one per key."""
    return new.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """``existing`` with the rows of ``new`` replacing or joining it by key.

    Of rows of ``new`` with one key the last by ``order`` counts, without it any one. ``store.replace_batch`` writes the result.
    """
    if order:
        best = F.max_by(F.struct(*new.columns), F.struct(order, F.xxhash64(*new.columns))).alias("_row")
        new = new.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best).select("_row.*")
    else:
        new = new.dropDuplicates(list(keys))
    return existing.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def backfill(df: DataFrame, done: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Rows still to be processed: those without a result, or all of them with ``force``."""
    return df if force else df.join(done.select(*keys), list(keys), "left_anti")
