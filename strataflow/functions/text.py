"""Text columns: excerpts and the parts an answer must show."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings every answer must have.
ANSWER_SECTIONS = (
    "Answer",
    "Evidence from Drilling Data",
    "Evidence from Daily Reports",
    "Reasoning",
    "Assumptions",
    "Confidence",
)

# A number with a unit; a quote with a date.  (?d): only \n ends a line.
MEASUREMENT = r"\d+(?:\.\d+)?\s*(?:m|m/hr|m/h|kN|kNm|sg|g/cm3|mPa|Pa|ppm|hrs?|days?|%)"
DATED_QUOTES = (
    r"(?id)DDR.*?(?:15[/_]9|F-\d).*?\d{4}",
    r"(?id)(?:DDR|report|daily)\s.*?\d{4}[-/]\d{2}[-/]\d{2}",
    r'(?d)"\*?\*?[A-Z].*?\*?\*?"',
)


def truncate_text(col: Column, n: int | None) -> Column:
    """The first ``n`` characters, or all for None."""
    return col if n is None else F.substring(col, 1, n)


def missing_sections(text: Column) -> Column:
    """Array of the headings the text does not have, in their fixed order."""
    tests = [
        F.when(~text.rlike(rf"(?i)##?\s*{re.escape(name)}"), F.lit(name)) for name in ANSWER_SECTIONS
    ]
    return F.array_compact(F.array(*tests))


def has_measurement(text: Column) -> Column:
    return text.rlike(MEASUREMENT)


def has_dated_quote(text: Column) -> Column:
    first, second, third = DATED_QUOTES
    return text.rlike(first) | text.rlike(second) | text.rlike(third)


def extract_confidence(text: Column) -> Column:
    word = F.upper(F.regexp_extract(text, r"(?i)\b(HIGH|MEDIUM|LOW)\b", 1))
    return F.when(F.coalesce(word, F.lit("")) == "", F.lit("N/A")).otherwise(word)
