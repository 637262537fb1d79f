"""Time use, downtime causes and drilling progress per well."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.activity import classify_time, npt_cause, productive_kind
from ..functions.names import of_well
from ..functions.numbers import duration_hrs, fixed_mean, truthy
from ..functions.predicates import in_dates
from ..functions.text import truncate_text
from .ordered import BY_DAY_AND_ID, running_counts, scan


def timed_activities(activities: DataFrame) -> DataFrame:
    """Activities with duration, time class and downtime cause."""
    code = F.col("activity_code")
    return activities.withColumns(
        {
            "duration_hrs": duration_hrs(F.col("start_ts"), F.col("end_ts")),
            "time_class": classify_time(code),
            "cause": npt_cause(code, F.col("comments")),
            "kind": productive_kind(code),
        }
    )


def time_breakdown(timed: DataFrame, by: list[str] = ["well"]) -> DataFrame:
    """Hours and share per time class, and problem rows."""
    hours = F.col("duration_hrs")
    classes = ("productive", "npt", "trip", "other")
    sums = [
        F.sum(F.when(F.col("time_class") == c, hours).otherwise(0.0)).alias(f"{c}_hrs") for c in classes
    ]
    out = timed.groupBy(*by).agg(
        *sums,
        F.sum(hours).alias("total_hrs"),
        F.count_if(F.col("state") == "problem").alias("problem_count"),
        F.count("*").alias("activities"),
    )
    return out.withColumns(
        {
            f"{c}_pct": F.when(F.col("total_hrs") > 0, F.col(f"{c}_hrs") / F.col("total_hrs") * 100.0)
            for c in classes
        }
    )


def npt_breakdown(timed: DataFrame) -> DataFrame:
    return (
        timed.filter(F.col("time_class") == "npt")
        .groupBy("well", "cause")
        .agg(F.sum("duration_hrs").alias("hrs"), F.count("*").alias("events"))
    )


def longest_npt_event(timed: DataFrame, chars: int | None = None) -> DataFrame:
    """Longest downtime row per well, the earliest one on ties; ``chars`` shortens its comment."""
    npt = timed.filter((F.col("time_class") == "npt") & (F.col("duration_hrs") > 0))
    # Earliest first on ties: the smallest struct starts with the negated hours.
    order = F.struct(-F.col("duration_hrs"), "date", "start_ts", "event_id")
    picked = F.struct(
        "duration_hrs", "date", "cause", truncate_text(F.col("comments"), chars).alias("comment")
    )
    return npt.groupBy("well").agg(F.min_by(picked, order).alias("e")).select("well", "e.*")


def productive_breakdown(timed: DataFrame) -> DataFrame:
    return (
        timed.filter(F.col("time_class") == "productive")
        .groupBy("well", "kind")
        .agg(F.sum("duration_hrs").alias("hrs"), F.count("*").alias("events"))
    )


def progress_by_hole(status: DataFrame) -> DataFrame:
    """Metres drilled and metres per report row for each hole size."""
    drilled = F.coalesce(
        F.nullif(F.sum("dist_drill_m"), F.lit(0.0)), F.max("md_m") - F.min("md_m")
    )
    return (
        status.filter(truthy(F.col("hole_diameter_in")) & truthy(F.col("md_m")))
        .groupBy("well", "hole_diameter_in")
        .agg(
            F.min("md_m").alias("min_md"),
            F.max("md_m").alias("max_md"),
            F.count("*").alias("n_days"),
            drilled.alias("drilled_m"),
        )
        .withColumn("m_per_day", F.col("drilled_m") / F.col("n_days"))
    )


def daily_increments(status: DataFrame) -> DataFrame:
    """Positive depth gain over the report before; a missing or zero depth breaks the pair."""
    rows = scan(
        status.select("well", "date", "report_no", "md_m"),
        ["well"],
        BY_DAY_AND_ID,
        ["date", "report_no"],
        lag={"prev_md": F.col("md_m")},
    )
    usable = truthy(F.col("md_m")) & truthy(F.col("prev_md"))
    return rows.filter(usable).withColumn("gain_m", F.col("md_m") - F.col("prev_md")).filter(
        F.col("gain_m") > 0
    )


def daily_progress_stats(status: DataFrame) -> DataFrame:
    """Min, max, mean and upper median of the positive daily gains."""
    gains = running_counts(daily_increments(status).select("well", "gain_m"), ["well"], "gain_m")
    return gains.groupBy("well").agg(
        F.min("gain_m").alias("min_gain"),
        F.max("gain_m").alias("max_gain"),
        fixed_mean("gain_m", F.col("n")).alias("mean_gain"),
        F.sum("n").alias("n_gains"),
        F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("gain_m"))).alias("median_gain"),
    )


def efficiency_metrics(
    tables: Mapping[str, DataFrame], date_from: str | None = None, date_to: str | None = None, well: str | None = None
) -> dict[str, DataFrame]:
    """All parts of the report; ``well`` is a name or a pattern, None for every well."""
    tables = of_well(tables, well)
    within = in_dates(F.col("date"), date_from, date_to)
    timed = timed_activities(tables["ddr_activities_timed"].filter(within))
    status = tables["ddr_status"].filter(within)
    return {
        "time": time_breakdown(timed),
        "npt": npt_breakdown(timed),
        "longest_npt": longest_npt_event(timed),
        "productive": productive_breakdown(timed),
        "progress": progress_by_hole(status),
        "daily": daily_progress_stats(status),
    }
