"""Distinct counts that merge: bitmaps of ids per fine group, joined by OR for any coarser one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_cube(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """(keys, bucket, ids): one bitmap of 32,768 ids per group and id range, to be stored.

    Ids are whole numbers; numbers that lie close together make few buckets. Null ids count nothing. A hot group is
    spread over its buckets, and rows are combined before the shuffle.
    """
    number = F.col(id_col).cast("long")
    rows = df.filter(F.col(id_col).isNotNull()).select(
        *keys, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("_bit")
    )
    return rows.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_bit").alias("ids"))


def distinct_totals(cube: DataFrame, keys: Sequence[str] = (), n: str = "incidents") -> DataFrame:
    """Distinct ids per coarser group, from the stored bitmaps alone; without keys one row, 0 for an empty cube."""
    merged = cube.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("ids").alias("ids"))
    counted = merged.select(*keys, F.bitmap_count("ids").alias("_n"))
    return counted.groupBy(*keys).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(n))


def merge_cubes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cube of both inputs together; ids that both hold count once."""
    both = old.unionByName(new)
    return both.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("ids").alias("ids"))
