"""Classification of activity rows by code, state detail and comment text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import strip

# Phase of each known activity code.
PHASE_OF_CODE = {
    "drilling -- drill": "Drilling",
    "drilling -- trip": "Tripping",
    "drilling -- ream": "Reaming",
    "drilling -- coring": "Coring",
    "cementing -- cement": "Cementing",
    "cementing -- casing": "Casing",
    "cementing -- liner": "Casing",
    "completion -- completion": "Completion",
    "completion -- gravel pack": "Completion",
    "completion -- perforate": "Completion",
    "completion -- stimulate": "Completion",
    "logging -- log": "Logging",
    "logging -- wireline": "Logging",
    "well_control -- kick": "Well Control",
    "well_control -- kill": "Well Control",
    "well_control -- shut-in": "Well Control",
    "equipment -- rig": "Equipment",
    "equipment -- bha": "Equipment",
    "equipment -- mud": "Mud Work",
    "interruption -- repair": "NPT - Repair",
    "interruption -- waiting on weather": "NPT - Weather",
    "interruption -- other": "Other",
    "interruption -- waiting": "NPT - Waiting",
    "interruption -- wait": "NPT - Waiting",
    "interruption -- maintain": "NPT - Repair",
    "testing -- test": "Testing",
    "testing -- dst": "Testing",
    "conditioning -- circulate": "Circulating",
    "conditioning -- displace": "Circulating",
}

# Cause of each non-productive code.
NPT_CAUSE_OF_CODE = {
    "interruption -- repair": "Equipment Repair",
    "interruption -- waiting on weather": "Weather",
    "interruption -- waiting": "Waiting",
    "interruption -- other": "Other NPT",
    "interruption -- wait": "Waiting",
    "interruption -- maintain": "Maintenance",
    "well_control -- kick": "Well Control",
    "well_control -- kill": "Well Control",
    "well_control -- shut-in": "Well Control",
}

# Comment words that name the cause of other non-productive time; first hit wins.
NPT_COMMENT_CAUSES = (
    (("cement", "waiting on cement", "woc"), "Waiting on Cement"),
    (("mwd", "lwd", "tool", "sensor", "probe", "signal"), "MWD/Tool Issue"),
    (("survey", "gyro"), "Survey Operations"),
    (("rig up", "rig down", "rigged", "r/u", "r/d", "nipple"), "Rig Up/Down"),
    (("circul", "displace", "sweep", "condition"), "Circulating/Conditioning"),
    (("crew", "safety", "meeting", "drill", "hse"), "Crew/Safety/Meeting"),
    (("slip", "cut", "drill line"), "Slip & Cut Drill Line"),
    (("test", "pressure test", "fit", "lot", "leak"), "Pressure Testing"),
)
NPT_UNCLASSIFIED = "Other NPT (unclassified)"

# Kind of work of each productive code.
PRODUCTIVE_KIND_OF_CODE = {
    "drilling -- drill": "Drilling",
    "drilling -- ream": "Reaming",
    "drilling -- coring": "Coring",
    "cementing -- cement": "Cementing",
    "cementing -- casing": "Casing",
    "completion -- completion": "Completion",
    "logging -- log": "Logging",
}

PHASE_LABELS = tuple(sorted(set(PHASE_OF_CODE.values()) | {"Other", "Unknown"}))


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    """TRUE where the text holds one of the words, in one pass over it."""
    return text.rlike("|".join(re.escape(w) for w in words))


def lookup(code: Column, table: dict[str, str]) -> Column:
    """Value of a fixed code table, NULL for other codes."""
    return F.element_at(
        F.create_map(*[F.lit(part) for pair in table.items() for part in pair]), code
    )


def first_match(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """CASE over ordered (condition, value) rules."""
    head, *rest = rules
    cascade = reduce(lambda acc, rule: acc.when(*rule), rest, F.when(*head))
    return cascade.otherwise(default)


def code_key(code: Column) -> Column:
    return strip(F.lower(F.coalesce(code, F.lit(""))))


def classify_phase(code: Column) -> Column:
    """Phase label: exact code, else the code's family, else Other; no code is Unknown."""
    key = code_key(code)
    family: dict[str, str] = {}
    for known, label in PHASE_OF_CODE.items():
        family.setdefault(known.split(" -- ")[0], label)
    by_family = first_match(
        [(key.startswith(prefix), F.lit(label)) for prefix, label in family.items()],
        F.lit("Other"),
    )
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit("Unknown")).otherwise(
        F.coalesce(lookup(key, PHASE_OF_CODE), by_family)
    )


def classify_time(code: Column) -> Column:
    """npt, productive, trip or other."""
    key = code_key(code)
    return (
        F.when(key.isin(*NPT_CAUSE_OF_CODE), F.lit("npt"))
        .when(key.isin(*PRODUCTIVE_KIND_OF_CODE), F.lit("productive"))
        .when(key.contains("trip"), F.lit("trip"))
        .otherwise(F.lit("other"))
    )


def npt_cause(code: Column, comments: Column) -> Column:
    """Cause label of a non-productive row, NULL for other rows."""
    text = F.lower(F.coalesce(comments, F.lit("")))
    by_comment = first_match(
        [(any_word(text, words), F.lit(label)) for words, label in NPT_COMMENT_CAUSES],
        F.lit(NPT_UNCLASSIFIED),
    )
    by_code = lookup(code_key(code), NPT_CAUSE_OF_CODE)
    return F.when(by_code == "Other NPT", by_comment).otherwise(by_code)


def productive_kind(code: Column) -> Column:
    return lookup(code_key(code), PRODUCTIVE_KIND_OF_CODE)


def issue_category(code: Column, detail: Column, comments: Column) -> Column:
    """One of ten issue labels; codes and details are compared in their own case."""
    # An empty code counts as the word below; it matches no rule.
    code = F.when(F.coalesce(code, F.lit("")) == "", F.lit("unknown")).otherwise(code)
    detail = F.coalesce(detail, F.lit(""))
    text = F.lower(F.coalesce(comments, F.lit("")))
    kicks = ("kick", "influx", "well control", "blowout", "shut in well")
    return first_match(
        [
            (code.contains("well_control") | any_word(text, kicks), F.lit("Well Control")),
            (
                code.contains("repair") | F.lower(code).contains("maintain"),
                F.lit("Equipment Repair"),
            ),
            (code.contains("waiting") & code.contains("weather"), F.lit("Weather Delay")),
            (code.contains("waiting"), F.lit("Waiting/Delay")),
            (detail.contains("equipment failure"), F.lit("Equipment Failure")),
            (
                detail.contains("mud loss") | (text.contains("loss") & text.contains("circulat")),
                F.lit("Mud Losses"),
            ),
            (text.contains("stuck"), F.lit("Stuck Pipe")),
            (text.contains("flow check"), F.lit("Flow Check")),
            (detail.contains("operation failed"), F.lit("Operational Difficulty")),
        ],
        F.lit("Other Issue"),
    )
