"""Text-quality audit: required headings, measurements, dated quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    extract_confidence,
    has_dated_quote,
    has_measurement,
    missing_sections,
)
from .ordered import union_all

# Warnings of the audit.
NO_MEASUREMENT = "No specific measurement with units found"
NO_QUOTE = "No DDR report quote with date attribution found"


def audit_answers(texts: DataFrame, text: str = "text") -> DataFrame:
    """Each text with its missing headings, evidence flags, warnings and verdict."""
    body = F.coalesce(text, F.lit(""))
    checked = texts.withColumns(
        {
            "missing_sections": missing_sections(body),
            "has_measurement": has_measurement(body),
            "has_ddr_quote": has_dated_quote(body),
            "confidence": extract_confidence(body),
        }
    )
    warnings = F.array_compact(
        F.array(
            F.when(
                F.size("missing_sections") > 0,
                F.concat(F.lit("Missing sections: "), F.array_join("missing_sections", ", ")),
            ),
            F.when(~F.col("has_measurement"), F.lit(NO_MEASUREMENT)),
            F.when(~F.col("has_ddr_quote"), F.lit(NO_QUOTE)),
        )
    )
    return checked.withColumns({"warnings": warnings, "valid": F.size("missing_sections") == 0})


def audit_summary(audited: DataFrame) -> DataFrame:
    """How many texts are valid, show a measurement or a quote, and carry each warning."""
    flags = audited.select(
        F.explode(
            F.concat(
                F.array(
                    F.when(F.col("valid"), F.lit("valid")).otherwise(F.lit("invalid")),
                    F.when(F.col("has_measurement"), F.lit("with_measurement")),
                    F.when(F.col("has_ddr_quote"), F.lit("with_ddr_quote")),
                ),
                F.transform("warnings", lambda w: F.concat(F.lit("warning: "), w)),
            )
        ).alias("item")
    )
    counted = flags.filter(F.col("item").isNotNull()).groupBy("item").agg(F.count("*").alias("cnt"))
    total = audited.agg(F.count("*").alias("cnt")).select(F.lit("texts").alias("item"), "cnt")
    return union_all([counted, total])
