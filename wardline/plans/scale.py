"""Helpers that keep plans distributed when one group, key or total is huge.

* totals over a whole table are scalar subqueries, never a window without partition keys;
* ranks and running totals are computed per range partition plus small per-partition offsets;
* top-k per group filters ``row_number() <= k``, which Spark limits before the shuffle;
* distinct counts per group are two partial aggregations, so a hot group is spread over its ids.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; unset, a local one in local mode, as in tests, and else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="wardline-")
    return _LOCAL["folder"]


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run inside the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns through a one-row generator, which the optimiser does not look through:
    later filters and projections then read the values instead of repeating the expressions.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def total(df: DataFrame, expression: Column) -> Column:
    """One aggregate of a table as a scalar subquery column."""
    return df.agg(expression.alias("value")).scalar()


def top_k(df: DataFrame, k: int, order: Sequence[Column], within: Sequence[str], name: str = "rank") -> DataFrame:
    """The first ``k`` rows per group with their position."""
    spec = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn(name, F.row_number().over(spec).cast("long")).filter(F.col(name) <= k)


def first_k(df: DataFrame, k: int, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """The first ``k`` rows of the whole table with their position; only ``k`` rows reach the window."""
    limited = df.orderBy(*order).limit(k)
    return limited.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def count_ids(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    flags: dict[str, Column] | None = None,
    n: str = "incidents",
) -> DataFrame:
    """Distinct ids per group, and distinct ids for which a flag holds at least once."""
    flags = flags or {}
    per_id = df.groupBy(*keys, id_col).agg(
        F.lit(1).alias("_one"), *[F.max(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in flags.items()]
    )
    counted = per_id.filter(F.col(id_col).isNotNull())
    return counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(n), *[F.count_if(F.col(name)).alias(name) for name in flags]
    )


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    totals: dict[str, Column],
    within: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums in ``order`` (optionally restarting per ``within`` group) without a
    single-task window: range-partition, sum inside each partition, add the sums of earlier
    partitions. ``order`` must be unique inside a group. The range-partitioned rows are
    checkpointed, so both branches see the same partition bounds.
    """
    groups = [F.col(name) for name in within]
    inputs = {f"_in_{name}": column for name, column in totals.items()}
    placed = df.select("*", *[column.alias(name) for name, column in inputs.items()])
    placed = placed.repartitionByRange(*[g.asc() for g in groups], *order)
    placed = durable(placed.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(
        *[F.col(c) for c in df.columns],
        "_part",
        *[F.sum(f"_in_{name}").over(inside).alias(name) for name in totals],
    )
    sums = placed.groupBy("_part", *within).agg(*[F.sum(f"_in_{name}").alias(f"_sum_{name}") for name in totals])
    # one row per range partition (and group), so this window is small by construction
    before = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sums.select(
        F.col("_part").alias("_o_part"),
        *[F.col(name).alias(f"_o_{name}") for name in within],
        *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_off_{name}") for name in totals],
    )
    on = F.col("_part") == F.col("_o_part")
    for name in within:
        on = on & F.col(name).eqNullSafe(F.col(f"_o_{name}"))
    joined = local.join(offsets, on)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(name) + F.col(f"_off_{name}")).alias(name) for name in totals],
    )


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank", within: Sequence[str] = ()) -> DataFrame:
    """Position of every row in ``order`` (unique), computed in parallel."""
    return running_totals(df, order, {name: F.lit(1).cast("long")}, within)
