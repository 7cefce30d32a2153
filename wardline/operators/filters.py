"""List, queue, pattern and look-back filters. Related tables only restrict, they never multiply rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFICIENT_STATES = (
    "ABSENT", "FAILED", "BYPASSED", "NOT_VERIFIED", "INCORRECTLY_ASSUMED", "PARTIALLY_EFFECTIVE",
)
NO_RULE = ("none", "unmatched", "no-rule-matched", "no_rule")


def icontains(columns: Sequence[str], needle: str) -> Column:
    """Any of the columns holds the text, ignoring case."""
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.lower(F.col(name)).contains(needle.lower()), F.lit(False))
    return hit


def _in_workspace(df: DataFrame, workspace: str | None, column: str | None) -> DataFrame:
    if column is None:
        return df
    return df.filter(F.col(column).isNull() if workspace is None else F.col(column) == workspace)


def filter_incidents(
    df: DataFrame,
    id_col: str = "incident_id",
    text: str | None = None,
    text_cols: Sequence[str] = (),
    equals: dict[str, object] | None = None,
    rule: str | None = None,
    tags: DataFrame | None = None,
    predictions: DataFrame | None = None,
    risk: str | None = None,
    psif: str | None = None,
    workspace: str | None = None,
    workspace_col: str | None = None,
    newest: Sequence[str] = (),
) -> DataFrame:
    """Incident list: free text over some columns, equality, rule (or no rule), risk and psif state.

    With ``predictions`` the prediction columns come along by a left join; ``newest`` orders by
    those columns descending, then by id.
    """
    out = _in_workspace(df, workspace, workspace_col)
    if text:
        out = out.filter(icontains(text_cols, text))
    for column, value in (equals or {}).items():
        out = out.filter(F.col(column) == value)
    if rule is not None and tags is not None:
        if rule.lower() in NO_RULE:
            out = out.join(tags.select(id_col), id_col, "left_anti")
        else:
            out = out.join(tags.filter(F.lower("rule") == rule.lower()).select(id_col), id_col, "left_semi")
    if predictions is not None:
        out = out.join(predictions, id_col, "left")
    if risk:
        out = out.filter(F.col("risk_level") == risk)
    if psif == "psif":
        out = out.filter(F.col("predicted") & ~F.col("sparse"))
    elif psif == "not_psif":
        out = out.filter(~F.col("predicted") & ~F.col("sparse"))
    elif psif == "sparse":
        out = out.filter(F.col("sparse"))
    if newest:
        out = out.orderBy(*[F.col(c).desc_nulls_last() for c in newest], F.col(id_col).asc())
    return out


def review_queue(
    df: DataFrame,
    predictions: DataFrame,
    quality: DataFrame,
    reviews: DataFrame,
    tags: DataFrame,
    id_col: str = "incident_id",
    review_state: str | None = None,
    decision: str | None = None,
    agreement: str | None = None,
    strength: str | None = None,
    quality_warning: bool = False,
    sparse: bool | None = None,
    psif: bool | None = None,
    rule: str | None = None,
    site: str | None = None,
    site_cols: Sequence[str] = ("department", "location"),
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
    activity: str | None = None,
    activity_cols: Sequence[str] = (),
) -> DataFrame:
    """Incidents waiting for or having had review, one row each, under eleven optional predicates."""
    out = df
    if review_state == "pending" or (review_state is None and decision is None and agreement is None):
        out = out.filter(F.col("adjudication_status") == "UNREVIEWED")
    elif review_state == "reviewed":
        out = out.filter(F.col("adjudication_status") == "ADJUDICATED")
    if decision == "unreviewed":
        out = out.filter(F.col("human_decision").isNull())
    elif decision:
        out = out.filter(F.col("human_decision") == decision)
    if site:
        out = out.filter(icontains(site_cols, site))
    if date_from:
        out = out.filter(F.col("incident_date") >= F.lit(date_from))
    if date_to:
        out = out.filter(F.col("incident_date") <= F.lit(date_to))
    if activity:
        out = out.filter(icontains(activity_cols, activity))
    if agreement:
        out = out.join(reviews.filter(F.col("agreement_state") == agreement).select(id_col), id_col, "left_semi")
    wanted = predictions
    if strength:
        wanted = wanted.filter(F.lower("evidence_strength") == strength.lower())
    if sparse is not None:
        wanted = wanted.filter(F.col("sparse") == sparse)
    if psif is not None:
        wanted = wanted.filter(F.col("predicted") == psif)
    if wanted is not predictions:
        out = out.join(wanted.select(id_col), id_col, "left_semi")
    if quality_warning:
        bad = quality.filter(F.col("quality_status").isin("WARNING", "CRITICAL")).select(id_col)
        out = out.join(bad, id_col, "left_semi")
    if rule:
        out = out.join(tags.filter(F.lower("rule").contains(rule.lower())).select(id_col), id_col, "left_semi")
    return out


def filter_observations(
    obs: DataFrame,
    id_col: str = "incident_id",
    psif: str | None = None,
    activity: str | None = None,
    barrier: str | None = None,
    text: str | None = None,
    text_cols: Sequence[str] = (),
) -> DataFrame:
    """Pattern observations of the incidents that match; all rows of a matching incident stay."""
    out = obs
    states = {"psif": "PSIF", "not_psif": "NOT_PSIF", "insufficient": "INSUFFICIENT_INFORMATION"}
    if psif in states:
        out = out.filter(F.col("psif_state") == states[psif])
    if text:
        out = out.filter(icontains(text_cols, text))
    if activity and activity != "all":
        hit = (F.col("dimension") == "activity") & F.lower("value").contains(activity.lower())
        out = out.join(out.filter(hit).select(id_col), id_col, "left_semi")
    if barrier and barrier != "all":
        hit = (
            (F.col("dimension") == "barrier")
            & F.col("control_state").isin(*DEFICIENT_STATES)
            & F.lower("value").contains(barrier.lower())
        )
        out = out.join(out.filter(hit).select(id_col), id_col, "left_semi")
    return out


def in_window(event_date: str, created: str | None, as_of: Column, days: int) -> Column:
    """Event date, or creation date where there is none, on or after ``as_of - days``."""
    day = F.col(event_date) if created is None else F.coalesce(F.col(event_date), F.to_date(F.col(created)))
    return day >= F.date_sub(as_of, days)


def latest_day(df: DataFrame, day: str) -> Column:
    """Newest date of a table as a scalar column: the default ``as_of``."""
    return df.agg(F.max(F.to_date(F.col(day)))).scalar()
