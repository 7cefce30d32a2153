"""Data-quality gate: findings per report, verdict, split, summaries."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.codes import percent
from wardline.functions.text import contains_any, is_sparse, strip
from wardline.plans.scale import once
from wardline.rules import quality as fixed

FINDING = "struct<check_id:string,severity:string,fields:array<string>,message:string,evidence:array<string>>"


@dataclass(frozen=True)
class ReportColumns:
    """Where the gate finds its inputs; ``None`` means the source has no such column."""

    narrative: str
    composite: str | None = None
    activity: str | None = None
    location: str | None = None
    body_part: str | None = None
    injury_type: str | None = None
    severity: str | None = None
    near_miss: str | None = None
    incident_date: str | None = None
    report_date: str | None = None

    def text(self, name: str) -> Column:
        column = getattr(self, name)
        return F.lit("") if column is None else F.coalesce(F.col(column).cast("string"), F.lit(""))

    def value(self, name: str, kind: str) -> Column:
        column = getattr(self, name)
        return F.lit(None).cast(kind) if column is None else F.col(column)


def finding(check_id: str, severity: str, fields: Sequence[str], message: str, *evidence: Column) -> Column:
    """One finding as a struct column."""
    proof = F.array(*evidence) if evidence else F.array().cast("array<string>")
    return F.struct(
        F.lit(check_id).alias("check_id"),
        F.lit(severity).alias("severity"),
        F.array(*[F.lit(f) for f in fields]).alias("fields"),
        F.lit(message).alias("message"),
        proof.alias("evidence"),
    )


def _placeholder_pattern() -> str:
    edges = "[" + re.escape(fixed.WORD_EDGES) + "]*+"
    single = [re.escape(p) for p in fixed.PLACEHOLDERS if " " not in p and any(c.isalnum() for c in p)]
    token = edges + "(?:" + "|".join(single) + ")" + edges + r"|\d++|[^\s\p{L}\p{N}]++"
    return r"(?U)^(?:\s*+(?:" + token + r")(?=\s|$))++\s*$"


def narrative_check(text: Column, low: Column) -> Column:
    """First matching check id for a trimmed narrative and its lower case, null when it is sound."""
    alnum, other = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
    stem = "^(?:" + "|".join(fixed.PLACEHOLDER_STEMS) + r")\s*\d*$"
    edges = "[" + re.escape(fixed.WORD_EDGES) + "]+"
    word = F.regexp_replace(F.regexp_extract(low, r"(?U)\S*[\p{L}\p{N}]\S*", 0), f"^{edges}|{edges}$", "")
    return (
        F.when(text == "", "MISSING_NARRATIVE")
        .when(text.contains("�") | text.contains("\u0000"), "UNSUPPORTED_ENCODING")
        .when(~text.rlike(alnum), "MEANINGLESS_NARRATIVE")
        .when(
            low.isin(*fixed.PLACEHOLDERS) | low.rlike(stem) | low.rlike(_placeholder_pattern()), "PLACEHOLDER_NARRATIVE"
        )
        .when(
            (F.length(text) >= 4) & low.rlike(f"^{other}*+({alnum})(?:{other}|\\1)*+$"), "CORRUPTED_NARRATIVE"
        )
        .when(text.rlike(f"^(?:{other}*+{alnum}){{4}}") & ~low.rlike("[aeiouy]"), "CORRUPTED_NARRATIVE")
        .when(contains_any(low, fixed.KEYBOARD_ROWS) | text.rlike(r"^[\d\s]+$"), "MEANINGLESS_NARRATIVE")
        .when(
            is_sparse(text, 2),
            F.when((F.length(word) > 3) & ~word.rlike("[aeiouy]"), "CORRUPTED_NARRATIVE").otherwise(
                "INSUFFICIENT_NARRATIVE"
            ),
        )
        .when(is_sparse(text), "SHORT_NARRATIVE")
    )


NARRATIVE_MESSAGES = {
    "MISSING_NARRATIVE": "The narrative is empty.",
    "UNSUPPORTED_ENCODING": "The narrative holds undecodable characters.",
    "MEANINGLESS_NARRATIVE": "The narrative holds no recognisable words.",
    "PLACEHOLDER_NARRATIVE": "The narrative is placeholder or test text.",
    "CORRUPTED_NARRATIVE": "The narrative is repeated or unreadable characters.",
    "INSUFFICIENT_NARRATIVE": "The narrative is a single word.",
    "SHORT_NARRATIVE": "The narrative has fewer than ten words.",
}


def check_narrative(df: DataFrame, narrative: str, name: str = "narrative_check") -> DataFrame:
    """Adds the narrative check id and its severity."""
    base = _with_texts(df, ReportColumns(narrative))
    checked = once(base, **{name: narrative_check(F.col("_text"), F.col("_low"))}).drop(*TEXTS)
    severity = F.when(F.col(name) == "SHORT_NARRATIVE", "warning").when(F.col(name).isNotNull(), "critical")
    return checked.withColumn(f"{name}_severity", severity)


TEXTS = ("_text", "_low", "_told")


def _with_texts(df: DataFrame, cols: ReportColumns) -> DataFrame:
    """Trimmed narrative, its lower case and the lower-cased composite text, each computed once."""
    text = strip(cols.text("narrative"))
    told = text if cols.composite is None else strip(cols.text("composite"))
    return once(df, _text=text, _low=F.lower(text), _told=F.lower(told))


def field_findings(cols: ReportColumns, domains: Mapping[str, Sequence[str]] | None = None) -> list[Column]:
    """Missing activity, placeholder location, values outside a closed list."""
    told = F.col("_text") != ""
    no_activity = strip(cols.text("activity")) == ""
    place = cols.text("location")
    found = [
        F.when(~told & no_activity, finding("MISSING_ACTIVITY", "critical", ["activity"], "The activity is missing.")),
        F.when(
            told & no_activity,
            finding("OPTIONAL_ACTIVITY_MISSING", "info", ["activity"], "The activity is not given."),
        ),
        F.when(
            F.lower(strip(place)).isin(*fixed.BAD_LOCATIONS),
            finding("INVALID_LOCATION", "warning", ["location"], "The location is a placeholder.", place),
        ),
    ]
    for column, values in (domains or {}).items():
        bad = F.col(column).isNotNull() & ~F.col(column).isin(*values)
        found.append(
            F.when(
                bad,
                finding("OUT_OF_DOMAIN", "warning", [column], "The value is not in its list.", F.col(column).cast("string")),
            )
        )
    return found


def conflict_findings(cols: ReportColumns) -> list[Column]:
    """Structured fields against each other and against the narrative."""
    text = F.col("_told")
    part, injury = F.lower(strip(cols.text("body_part"))), F.lower(strip(cols.text("injury_type")))
    raw_part, raw_injury = cols.text("body_part"), cols.text("injury_type")
    severity = F.lower(strip(cols.text("severity")))
    miss = F.coalesce(cols.value("near_miss", "boolean"), F.lit(False))
    found = [
        F.when(
            injury.contains("eye") & contains_any(part, fixed.EYE_CONFLICT_PARTS),
            finding(
                "INJURY_BODY_PART_CONFLICT", "critical", ["injury_type", "body_part"],
                "Injury type and body part contradict each other.", raw_injury, raw_part,
            ),
        )
    ]
    for name in fixed.BODY_PARTS:
        pattern = fixed.BODY_PART_PATTERN.format(part=name)
        found.append(
            F.when(
                (part != "") & ~part.contains(name) & text.rlike(pattern),
                finding(
                    "INJURY_BODY_PART_CONFLICT", "critical", ["description", "body_part"],
                    "The narrative names another body part.", F.regexp_extract(text, pattern, 0), raw_part,
                ),
            )
        )
    for name, pattern in fixed.INJURY_TYPE_PATTERNS.items():
        found.append(
            F.when(
                (injury != "") & ~injury.contains(name) & text.rlike(pattern),
                finding(
                    "INJURY_TYPE_CONFLICT", "warning", ["description", "injury_type"],
                    "The narrative names another injury type.", F.regexp_extract(text, pattern, 0), raw_injury,
                ),
            )
        )
    outcome = severity.isin(*fixed.SEVERE_OUTCOMES)
    return found + [
        F.when(
            severity.isin("none", "0") & text.rlike(fixed.SEVERE_WORDS),
            finding(
                "SEVERITY_NARRATIVE_CONFLICT", "warning", ["description", "severity_actual"],
                "No severity is recorded but the narrative tells of serious harm.",
                cols.text("severity"), F.regexp_extract(text, fixed.SEVERE_WORDS, 0),
            ),
        ),
        F.when(
            miss & outcome,
            finding(
                "NEAR_MISS_SEVERITY_CONFLICT", "critical", ["near_miss", "severity_actual"],
                "A near miss can not have this outcome.", F.lit("near_miss=True"), cols.text("severity"),
            ),
        ),
        F.when(
            miss & ~outcome & text.rlike(fixed.INJURY_WORDS),
            finding(
                "NEAR_MISS_INJURY_CONFLICT", "warning", ["description", "near_miss"],
                "A near miss but the narrative tells of an injury.",
                F.lit("near_miss=True"), F.regexp_extract(text, fixed.INJURY_WORDS, 0),
            ),
        ),
    ]


def date_findings(cols: ReportColumns, as_of: Column) -> list[Column]:
    """Future, impossible, contradictory and missing dates; ``as_of`` stands for today."""
    day, reported = cols.value("incident_date", "date"), cols.value("report_date", "date")
    iso, reported_iso = F.date_format(day, "yyyy-MM-dd"), F.date_format(reported, "yyyy-MM-dd")
    bounds = (F.year(day) < 1970) | (F.year(day) > 2050)
    return [
        F.when(day > as_of, finding("FUTURE_DATE", "critical", ["incident_date"], "The date is in the future.", iso)),
        F.when(
            (day <= as_of) & bounds,
            finding("IMPOSSIBLE_DATE", "critical", ["incident_date"], "The date is out of bounds.", iso),
        ),
        F.when(
            day > reported,
            finding(
                "CONTRADICTORY_DATE", "critical", ["incident_date", "report_date"],
                "The incident comes after its report.", iso, reported_iso,
            ),
        ),
        F.when(day.isNull(), finding("MISSING_DATE", "warning", ["incident_date"], "The date is missing.")),
    ]


def _compact(found: Sequence[Column]) -> Column:
    return F.array_compact(F.array(*found)).cast(f"array<{FINDING}>")


def _add(df: DataFrame, cols: ReportColumns, name: str, found: Sequence[Column]) -> DataFrame:
    return once(_with_texts(df, cols), **{name: _compact(found)}).drop(*TEXTS)


def check_fields(df: DataFrame, cols: ReportColumns, domains: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    return _add(df, cols, "field_findings", field_findings(cols, domains))


def check_conflicts(df: DataFrame, cols: ReportColumns) -> DataFrame:
    return _add(df, cols, "conflict_findings", conflict_findings(cols))


def check_dates(df: DataFrame, cols: ReportColumns, as_of: Column) -> DataFrame:
    return df.withColumn("date_findings", _compact(date_findings(cols, as_of)))


def quality_gate(
    df: DataFrame,
    cols: ReportColumns,
    as_of: Column | None = None,
    domains: Mapping[str, Sequence[str]] | None = None,
    with_dates: bool = True,
) -> DataFrame:
    """Adds ``findings``, ``quality_status``, ``quality_score``, ``accepted`` and ``missing_fields``."""
    as_of = F.current_date() if as_of is None else as_of
    base = _with_texts(df, cols)
    checked = once(base, _check=narrative_check(F.col("_text"), F.col("_low")))
    level = F.when(F.col("_check") == "SHORT_NARRATIVE", "warning").when(F.col("_check").isNotNull(), "critical")
    message = F.coalesce(*[F.when(F.col("_check") == c, F.lit(m)) for c, m in NARRATIVE_MESSAGES.items()])
    text = cols.text("narrative")
    proof = (
        F.when(F.col("_check") == "MISSING_NARRATIVE", F.array().cast("array<string>"))
        .when(F.col("_check") == "UNSUPPORTED_ENCODING", F.array(F.substring("_text", 1, 60)))
        .otherwise(F.array(text))
    )
    narrative = F.when(
        F.col("_check").isNotNull(),
        F.struct(
            F.col("_check").alias("check_id"),
            level.alias("severity"),
            F.array(F.lit("description")).alias("fields"),
            message.alias("message"),
            proof.alias("evidence"),
        ),
    )
    found = [narrative, *field_findings(cols, domains), *conflict_findings(cols)]
    if with_dates:
        found += date_findings(cols, as_of)
    missing = F.array_compact(
        F.array(
            F.when(F.col("_check").isin("MISSING_NARRATIVE", "INSUFFICIENT_NARRATIVE"), F.lit("description")),
            F.when(
                (F.col("_check") == "MISSING_NARRATIVE") & (strip(cols.text("activity")) == ""), F.lit("activity")
            ),
        )
    )
    gated = once(checked, findings=_compact(found), missing_fields=missing)
    has = lambda level: F.exists("findings", lambda f: f["severity"] == level)
    status = F.when(has("critical"), "CRITICAL").when(has("warning"), "WARNING").otherwise("VALID")
    gated = gated.withColumn("quality_status", status)
    return gated.withColumns(
        {
            "accepted": F.col("quality_status") != "CRITICAL",
            "quality_score": F.when(F.col("quality_status") == "CRITICAL", 0.0)
            .when(F.col("quality_status") == "WARNING", 0.75)
            .otherwise(1.0),
        }
    ).drop("_check", *TEXTS)


def split_by_gate(gated: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """Accepted reports, and rejects with row, reason and blocking check ids.

    Both are filters over the same frame; persist or write it first when both are used.
    """
    blocking = F.transform(F.filter("findings", lambda f: f["severity"] == "critical"), lambda f: f["check_id"])
    rejects = gated.filter(~F.col("accepted")).select(
        row,
        F.lit("Data quality is insufficient for analysis.").alias("reason"),
        F.array_distinct(blocking).alias("blocking_checks"),
    )
    return gated.filter("accepted"), rejects


def gate_summary(gated: DataFrame, *by: str) -> DataFrame:
    """Total, accepted, accepted with warnings and rejected reports."""
    return gated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("accepted").alias("accepted"),
        F.count_if(F.col("quality_status") == "WARNING").alias("with_warnings"),
        F.count_if(~F.col("accepted")).alias("rejected"),
    )


def fingerprint(text: Column) -> Column:
    """16 hex digits of SHA-256 over the lower-cased ASCII words; empty for missing text."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\b[a-zA-Z0-9]+\b"), 0)
    joined = F.lower(F.array_join(words, " "))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.substring(F.sha2(joined, 256), 1, 16))


def duplicate_groups(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """(fingerprint, copies, first_id) for narratives that occur more than once."""
    prints = df.select(id_col, fingerprint(F.col(text)).alias("fingerprint")).filter(F.col("fingerprint") != "")
    groups = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id"))
    return groups.filter(F.col("copies") > 1)


def evidence_state(
    gated: DataFrame,
    narrative: str,
    sparse: Column | None = None,
    insufficient: Column | None = None,
    cues: Sequence[str] = fixed.HAZARD_CUES,
) -> DataFrame:
    """Adds ``evidence_state``: invalid, sparse, insufficient, low evidence or valid."""
    short = F.exists("findings", lambda f: f["check_id"].isin("SHORT_NARRATIVE", "INSUFFICIENT_NARRATIVE"))
    sparse = F.lit(False) if sparse is None else F.coalesce(sparse, F.lit(False))
    insufficient = F.lit(False) if insufficient is None else F.coalesce(insufficient, F.lit(False))
    state = (
        F.when(F.col("quality_status") == "CRITICAL", "INVALID_DATA")
        .when(short | sparse, "SPARSE_DATA")
        .when(insufficient, "INSUFFICIENT_INFORMATION")
        .when(~contains_any(F.lower(F.col(narrative)), cues), "VALID_LOW_EVIDENCE")
        .otherwise("VALID")
    )
    return gated.withColumn("evidence_state", state)


def quality_report(
    df: DataFrame, status: str, fields: Mapping[str, str], sparse: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Long report (measure, n, rate) of status counts, pending rows, sparse rows and missing fields."""
    blank = {f"missing_{name}": F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for name, c in fields.items()}
    measures = {
        "valid": F.col(status) == "VALID",
        "warning": F.col(status) == "WARNING",
        "critical": F.col(status) == "CRITICAL",
        "pending": F.col(status).isNull(),
        "sparse": sparse,
        **blank,
    }
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(condition).alias(name) for name, condition in measures.items()]
    )
    long = counts.select(
        *by,
        "_total",
        F.stack(F.lit(len(measures)), *[x for name in measures for x in (F.lit(name), F.col(name))]).alias("measure", "n"),
    )
    return long.select(*by, "measure", "n", percent(F.col("n"), F.col("_total"), 2).alias("rate"))

