"""Incremental ingestion, live counters and recurrence alerts.

Ingestion writes each micro-batch to its own partition by overwriting it, so a retried batch has the
effect of one; ids seen in earlier batches are left out by an anti-join on the id column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators.quality import split_by_gate

BATCH = "batch_id"


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds any table, asked of the file system that owns the path."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Replace the partition of one micro-batch; a repeated call leaves the same files."""
    rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")


def unseen(rows: DataFrame, path: str, key: str, batch: int) -> DataFrame:
    """Rows whose key is in no earlier batch, one per key."""
    fresh = rows.dropDuplicates([key])
    if not table_exists(rows.sparkSession, path):
        return fresh
    earlier = rows.sparkSession.read.parquet(path).filter(F.col(BATCH) < batch).select(key)
    return fresh.join(earlier, key, "left_anti")


def ingest_stream(
    source: DataFrame,
    prepare: Callable[[DataFrame], DataFrame],
    tag: Callable[[DataFrame], DataFrame] | None,
    target: str,
    key: str = "incident_id",
):
    """New files to ``target``/accepted, /rejected and /tags; resumes where it stopped.

    ``prepare`` maps a batch to gated rows (it adds ``accepted`` and ``findings``), ``tag`` makes rule
    tags of the accepted rows.
    """

    def one_batch(batch_rows: DataFrame, batch: int) -> None:
        staged = f"{target}/staged"
        write_batch(prepare(batch_rows), staged, batch)
        gated = batch_rows.sparkSession.read.parquet(f"{staged}/{BATCH}={batch}")
        good, bad = split_by_gate(gated, key)
        write_batch(unseen(good, f"{target}/accepted", key, batch), f"{target}/accepted", batch)
        write_batch(bad, f"{target}/rejected", batch)
        if tag is not None:
            kept = batch_rows.sparkSession.read.parquet(f"{target}/accepted/{BATCH}={batch}")
            write_batch(tag(kept), f"{target}/tags", batch)

    return (
        source.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, kind: str = "parquet", pattern: str | None = None,
    files_per_batch: int = 100,
) -> DataFrame:
    """Files arriving in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.format(kind).load(folder)


def live_counters(stream: DataFrame, *keys: str) -> DataFrame:
    """Running counts per dataset and state, one state row a key; write with update output."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def recurrence_alerts(
    stream: DataFrame,
    event_time: str,
    keys: list[str],
    id_col: str,
    length: str = "7 days",
    slide: str = "1 day",
    lateness: str = "2 days",
    min_count: int = 3,
) -> DataFrame:
    """Windows in which a key combination has at least ``min_count`` different incidents, for append output:
    a window is told and its state dropped once ``lateness`` has passed after its end.

    Repeated ids inside the lateness bound are dropped first, as streams can not count distinct.
    """
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    once = timed.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([id_col])
    counted = once.groupBy(F.window(event_time, length, slide), *keys).agg(
        F.count(F.lit(1)).alias("incidents"), F.min(event_time).alias("first_seen"), F.max(event_time).alias("last_seen")
    )
    return counted.filter(F.col("incidents") >= min_count)


def run_to_table(stream: DataFrame, target: str, mode: str = "append") -> None:
    """Run all available input once. Each micro-batch is a partition of ``target``/result that a retry replaces.

    ``append`` writes a row once, when it is final: windows leave the state as the watermark passes them.
    ``update`` writes only the rows that changed; ``latest`` reads the last one of each key.
    """
    if mode not in ("append", "update"):
        raise ValueError("append or update: a complete result would be kept and written again for ever")

    def write(batch_rows: DataFrame, batch: int) -> None:
        write_batch(batch_rows, f"{target}/result", batch)

    (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the last micro-batch for each key."""
    values = [c for c in rows.columns if c not in (*keys, BATCH)]
    return rows.groupBy(*keys).agg(*[F.max_by(c, BATCH).alias(c) for c in values])
