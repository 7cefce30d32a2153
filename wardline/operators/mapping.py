"""From source rows to typed canonical reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.codes import first_entry, short_text
from wardline.plans.scale import once
from wardline.rules.fields import (
    CANONICAL_FIELDS,
    FIELD_ALIASES,
    LABEL_SOURCES,
    LONG_TEXT_FIELDS,
    SCORING_FIELDS,
    UUID_DNS_NAMESPACE,
)


def field_for_key(key: Column, aliases: Mapping[str, Sequence[str]] = FIELD_ALIASES) -> Column:
    """Canonical field of one source column name: exact, else longest alias containing or contained."""
    name = F.replace(F.replace(F.lower(F.trim(key)), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))
    exact = F.replace(name, F.lit(" "), F.lit("_"))
    longest_first = sorted(
        ((alias.lower(), field) for field, names in aliases.items() for alias in names), key=lambda pair: -len(pair[0])
    )
    by_alias = first_entry(longest_first, lambda alias: F.contains(name, alias) | F.contains(alias, name))
    return F.when(name != "", F.coalesce(F.when(exact.isin(*aliases), exact), by_alias))


def key_mapping(
    df: DataFrame, source: str, values: str, aliases: Mapping[str, Sequence[str]] = FIELD_ALIASES
) -> DataFrame:
    """(source, key, canonical): each target goes to the first key of a source that asks for it."""
    keys = df.select(source, F.posexplode(F.map_keys(values)).alias("position", "key"))
    keys = keys.groupBy(source, "key").agg(F.min("position").alias("position"))
    keys = once(keys, canonical=field_for_key(F.col("key"), aliases))
    return (
        keys.filter(F.col("canonical").isNotNull())
        .groupBy(source, "canonical")
        .agg(F.min(F.struct("position", "key")).alias("first"))
        .select(source, F.col("first.key").alias("key"), "canonical")
    )


def harmonise_keys(
    df: DataFrame, source: str, row: str, values: str, aliases: Mapping[str, Sequence[str]] = FIELD_ALIASES
) -> DataFrame:
    """Rows held as string maps to (source, row, canonical, value)."""
    mapping = key_mapping(df, source, values, aliases)
    long = df.select(source, row, F.explode(values).alias("key", "value"))
    return long.join(mapping, [source, "key"]).select(source, row, "canonical", "value")


def pivot_fields(
    long: DataFrame, source: str, row: str, fields: Sequence[str] = CANONICAL_FIELDS
) -> DataFrame:
    """Long harmonised rows back to one row per report with the canonical columns."""
    return long.groupBy(source, row).pivot("canonical", list(fields)).agg(F.first("value"))


def mapping_conflicts(
    mapping: DataFrame, source: str, key: str, canonical: str, fields: Sequence[str] = CANONICAL_FIELDS
) -> DataFrame:
    """(source, canonical, problem, keys) for unknown targets and targets mapped more than once."""
    used = mapping.filter(F.coalesce(F.col(canonical), F.lit("")) != "")
    per_target = used.groupBy(source, canonical).agg(F.count_distinct(key).alias("keys"))
    known = F.col(canonical).isin(*fields)
    problem = F.when(~known, "UNKNOWN_TARGET").when(F.col("keys") > 1, "DUPLICATE_TARGET")
    return per_target.select(source, F.col(canonical).alias("canonical"), problem.alias("problem"), "keys").filter(
        F.col("problem").isNotNull()
    )


def apply_mapping(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] = (), max_len: int | None = None) -> DataFrame:
    """Mapped columns trimmed; with ``max_len`` all but the long narratives are cut to so many characters."""
    return df.select(
        *keep,
        *[
            short_text(F.col(column).cast("string"), None if field in LONG_TEXT_FIELDS else max_len).alias(field)
            for field, column in mapping.items()
        ],
    )


def with_raw_row(df: DataFrame, name: str = "raw_row", columns: Sequence[str] | None = None) -> DataFrame:
    """The source row kept verbatim as JSON, nulls included."""
    picked = F.struct(*(columns or df.columns))
    return df.withColumn(name, F.to_json(picked, {"ignoreNullFields": "false"}))


def uuid5(name: Column, namespace: str = UUID_DNS_NAMESPACE) -> Column:
    """Name-based UUID (version 5) with native hashing."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(
        F.lit("89ab89ab89ab89ab"), F.instr(F.lit("0123456789abcdef"), F.substring(digest, 17, 1)), F.lit(1)
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def with_stable_id(
    df: DataFrame, dataset: str, external: str | None = None, row: str | None = None, name: str = "incident_id",
) -> DataFrame:
    """Same source row, same id on every retry: by external id where there is one, else by row number."""
    by_row = F.concat(F.col(dataset).cast("string"), F.lit(":row:"), F.col(row).cast("string")) if row else F.lit(None)
    if external:
        text = F.nullif(F.trim(F.col(external).cast("string")), F.lit(""))
        by_external = F.concat(F.col(dataset).cast("string"), F.lit(":ext:"), text)
        return df.withColumn(name, uuid5(F.coalesce(by_external, by_row)))
    return df.withColumn(name, uuid5(by_row))


def stamp_provenance(df: DataFrame, datasets: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Workspace, synthetic flag and label source of the dataset on every report.

    ``datasets`` has ``key``, ``workspace_id``, ``is_synthetic`` and ``source_provenance``.
    """
    source = F.lit("none")
    for provenance, label in LABEL_SOURCES.items():
        source = F.when(F.col("source_provenance") == provenance, label).otherwise(source)
    sets = datasets.select(
        key, "workspace_id", F.col("is_synthetic").alias("_synthetic"), source.alias("_label_source")
    )
    return df.join(sets, key, "left").select(
        *df.columns,
        "workspace_id",
        F.coalesce("_synthetic", F.lit(False)).alias("is_synthetic"),
        F.coalesce("_label_source", F.lit("none")).alias("label_source"),
    )


def derive_flags(
    df: DataFrame,
    condition: str = "control_condition",
    failed: str = "control_failed_bypassed",
    report_type: str = "report_type",
    near_miss: str = "near_miss",
    severity: str = "severity_actual",
) -> DataFrame:
    """Control condition sets the failed flag; report type fills a missing near-miss flag."""
    failed_now = (
        F.when(F.col(condition).isin("failed", "bypassed"), F.lit(True))
        .when(F.col(condition).isin("effective", "absent"), F.lit(False))
        .otherwise(F.col(failed))
    )
    miss_now = F.coalesce(
        F.col(near_miss),
        F.when(F.col(report_type) == "near_miss", F.lit(True)).when(
            (F.col(report_type) == "incident") & (F.col(severity) != "none"), F.lit(False)
        ),
    )
    return df.withColumns({failed: failed_now, near_miss: miss_now})


def prediction_record(
    df: DataFrame, keep: Sequence[str] = (), allowed: Sequence[str] = SCORING_FIELDS
) -> DataFrame:
    """Only the inputs a score may use, so outcomes and labels can not leak into it."""
    return df.select(*keep, *[c for c in allowed if c in df.columns])
