"""End-to-end plan: source rows to gated, tagged reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.codes import normalise_code, parse_date, parse_flag
from wardline.functions.text import compose_text, is_sparse
from wardline.operators.mapping import apply_mapping, with_stable_id
from wardline.operators.quality import ReportColumns, quality_gate, split_by_gate
from wardline.operators.tagging import tag_rules
from wardline.rules.fields import CANONICAL_FIELDS, SEVERITY_ACTUAL, SEVERITY_POTENTIAL
from wardline.rules.tagging import LIFE_SAVING_KEYWORDS


@dataclass(frozen=True)
class Ingested:
    """Lazy outputs of one ingestion; write ``gated`` first when several of them are used."""

    gated: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    tags: DataFrame


def typed_reports(df: DataFrame, mapping: Mapping[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Canonical report columns with their types, composite narrative and sparse flag.

    Without a mapping the canonical columns are taken as they are.
    """
    mapping = mapping or {f: f for f in CANONICAL_FIELDS if f in df.columns}
    rows = apply_mapping(df, mapping, keep)
    for field in CANONICAL_FIELDS:
        if field not in mapping:
            rows = rows.withColumn(field, F.lit(None).cast("string"))
    return rows.withColumns({
        "incident_date": parse_date(F.col("incident_date")),
        "near_miss": parse_flag(F.col("near_miss")),
        "severity_actual": normalise_code(F.col("severity_actual"), SEVERITY_ACTUAL),
        "severity_potential": normalise_code(F.col("severity_potential"), SEVERITY_POTENTIAL),
        "composite_narrative": F.nullif(
            compose_text(["description", "corrective_actions", "witness_statement"]), F.lit("")
        ),
    }).withColumn("is_sparse", is_sparse("composite_narrative"))


def ingest(
    df: DataFrame,
    dataset: Column,
    mapping: Mapping[str, str] | None = None,
    row: str | None = None,
    as_of: Column | None = None,
    rules: Mapping[str, Sequence[str]] = LIFE_SAVING_KEYWORDS,
) -> Ingested:
    """Map, type, identify, gate and tag the rows of a dataset; the same path for files and tables."""
    keep = [row] if row else []
    typed = typed_reports(df, mapping, keep).withColumn("dataset_id", dataset)
    known = with_stable_id(typed, "dataset_id", "external_id", row)
    cols = ReportColumns(
        "description", "composite_narrative", "job_task", "location", "body_part", "injury_type", "severity_actual",
        "near_miss", "incident_date",
    )
    gated = quality_gate(known, cols, as_of)
    accepted, rejected = split_by_gate(gated, "incident_id")
    fields = {"description": "description", "job_task": "job_task", "corrective_actions": "corrective_actions"}
    return Ingested(gated, accepted, rejected, tag_rules(accepted, "incident_id", fields, rules))
