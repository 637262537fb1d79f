"""Row filters as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .activity import any_word

# Words searched in comments and summaries.
ISSUE_WORDS = ("kick", "influx", "shut in", "well control", "flow check", "blowout")
ISSUE_DETAILS = ("equipment failure", "mud loss", "operation failed")
SUMMARY_PROBLEM_WORDS = (
    "problem", "issue", "failure", "stuck", "loss", "kick", "repair", "wait",
)
BHA_WORDS = ("bha", "bit", "pick up", "p/u", "tripped out", "pooh", "new assembly")
SEVERE_WORDS = (
    "stuck", "tight hole", "pack off", "packing-off", "lost circulation", "mud loss",
    "losses", "kick", "influx", "cavings", "slough",
)
FISHING_WORDS = ("fish", "fishing")


def _all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def in_dates(date: Column, date_from: str | None = None, date_to: str | None = None) -> Column:
    """Inclusive range over ISO date text."""
    bounds = []
    if date_from is not None:
        bounds.append(date >= F.lit(date_from))
    if date_to is not None:
        bounds.append(date <= F.lit(date_to))
    return _all_of(bounds)


def in_depths(depth: Column, depth_from: float | None = None, depth_to: float | None = None) -> Column:
    """Inclusive depth range; rows without a depth fall out as soon as a bound is given."""
    bounds = []
    if depth_from is not None:
        bounds.append(depth >= F.lit(float(depth_from)))
    if depth_to is not None:
        bounds.append(depth <= F.lit(float(depth_to)))
    return _all_of(bounds)


def in_wells(well: Column, wells: list[str] | None = None) -> Column:
    return F.lit(True) if not wells else well.isin(*wells)


def _missing_or_within(col: Column, upper: float) -> Column:
    return col.isNull() | ((col > 0) & (col <= upper))


def mudlog_quality(with_torque: bool = True) -> Column:
    """Plausible drilling parameters: ROP must be there, the others only if given."""
    rop = F.col("rop_avg_m_per_hr")
    keep = (
        rop.isNotNull()
        & (rop > 0)
        & (rop <= 200)
        & _missing_or_within(F.col("rpm_avg"), 300)
        & _missing_or_within(F.col("wob_avg_kN"), 500)
    )
    return keep & _missing_or_within(F.col("torque_avg_kNm"), 100) if with_torque else keep


def is_issue() -> Column:
    code = F.col("activity_code")
    flagged = (
        (F.col("state") == "problem")
        | code.startswith("interruption")
        | code.startswith("well_control")
        | F.col("state_detail").isin(*ISSUE_DETAILS)
        | any_word(F.lower("comments"), ISSUE_WORDS)
    )
    return F.coalesce(flagged, F.lit(False))


def is_problem_summary() -> Column:
    return F.coalesce(any_word(F.col("summary_24hr"), SUMMARY_PROBLEM_WORDS), F.lit(False))


def mentions_bha() -> Column:
    return F.coalesce(any_word(F.lower("comments"), BHA_WORDS), F.lit(False))


def mentions_severe() -> Column:
    return any_word(F.lower(F.coalesce("comments", F.lit(""))), SEVERE_WORDS)


def mentions_fishing() -> Column:
    return any_word(F.lower(F.coalesce("comments", F.lit(""))), FISHING_WORDS)
