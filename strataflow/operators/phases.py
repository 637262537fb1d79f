"""Hole-section phases, their contents, depth reversals and plot series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.activity import PHASE_LABELS, classify_phase
from ..functions.names import of_well
from ..functions.numbers import hole_section_name, truthy
from ..functions.predicates import in_dates
from ..functions.text import truncate_text
from .ordered import BY_DAY_AND_ID, scan, union_all
from .overview import share_of_well


def hole_phases(status: DataFrame) -> DataFrame:
    """Runs of equal hole size in date order; rows without a size carry the last one forward.

    A phase ends on the row that starts the next one; the last phase ends on the last row.
    """
    rows = status.select("well", "date", "report_no", "md_m", "hole_diameter_in")
    size = F.col("hole_diameter_in")
    known = scan(
        rows,
        ["well"],
        BY_DAY_AND_ID,
        ["date", "report_no"],
        last_known={"prev_hole": F.when(truthy(size), size)},
        lead={"_following": F.lit(1)},
    )
    # A row may start a phase, be the last of its well, or both.
    starts = F.when(truthy(size) & ~size.eqNullSafe(F.col("prev_hole")), F.lit(0))
    ends = F.when(F.col("_following").isNull(), F.lit(1))
    edges = known.withColumn("is_end", F.explode(F.array_compact(F.array(starts, ends)))).select(*rows.columns, "is_end")
    marked = scan(
        edges,
        ["well"],
        BY_DAY_AND_ID,
        ["date", "report_no", "is_end"],
        lead={"_next": F.struct("date", "md_m")},
        total={"phase_no": F.lit(1)},
    )
    return marked.filter(F.col("is_end") == 0).select(
        "well",
        "phase_no",
        "hole_diameter_in",
        hole_section_name(F.col("hole_diameter_in")).alias("section"),
        F.col("date").alias("start_date"),
        F.col("_next.date").alias("end_date"),
        F.col("md_m").alias("start_md"),
        F.col("_next.md_m").alias("end_md"),
    )


def _daily_calendar(status: DataFrame, activities: DataFrame) -> DataFrame:
    """One row per (well, date) with counts up to and before that date.

    A phase is a date range, so everything counted over it is a difference of two running counts.
    The windows run over days, which the calendar bounds, never over reports or activities.
    """
    has_text = F.coalesce("summary_24hr", F.lit("")) != ""
    reports = status.groupBy("well", "date").agg(
        F.count("*").alias("n_reports"),
        F.min_by("md_m", F.when(truthy(F.col("md_m")), F.col("report_no"))).alias("first_md"),
        F.min_by("summary_24hr", F.when(has_text, F.col("report_no"))).alias("summary"),
    )
    # Counts per label first: the label is computed once a row, the columns once a day.
    per_label = (
        activities.withColumn("label", classify_phase(F.col("activity_code")))
        .groupBy("well", "date", "label")
        .agg(F.count("*").alias("n"), F.count_if(F.col("state") == "problem").alias("problems"))
    )
    work = per_label.groupBy("well", "date").agg(
        F.sum("n").alias("n_activities"),
        F.sum("problems").alias("n_problems"),
        *[
            F.sum(F.when(F.col("label") == name, F.col("n")).otherwise(0)).alias(f"n_{i}")
            for i, name in enumerate(PHASE_LABELS)
        ],
    )
    counted = ["n_reports", "n_activities", "n_problems", *[f"n_{i}" for i in range(len(PHASE_LABELS))]]
    days = reports.join(work, ["well", "date"], "full").fillna(0, counted)
    by_day = Window.partitionBy("well").orderBy("date")
    upto = by_day.rowsBetween(Window.unboundedPreceding, 0)
    backwards = Window.partitionBy("well").orderBy(F.desc("date"))
    return days.select(
        "well",
        "date",
        "first_md",
        *[F.sum(c).over(upto).alias(f"upto_{c}") for c in counted],
        *[F.col(c).alias(f"day_{c}") for c in counted],
        F.last(F.when(F.col("summary").isNotNull(), F.struct("date", "summary")), True)
        .over(backwards.rowsBetween(Window.unboundedPreceding, 0))
        .alias("next_summary"),
    )


def phase_details(
    phases: DataFrame, status: DataFrame, activities: DataFrame, chars: int | None = None
) -> DataFrame:
    """Report days, casing point, activity mix, problems and first summary of each phase.

    ``chars`` shortens the summary.
    """
    days = _daily_calendar(status, activities)
    counted = [c.removeprefix("upto_") for c in days.columns if c.startswith("upto_")]
    # Both edges of a phase look up the calendar in one join and meet again by phase.
    edges = phases.select(
        "well", "phase_no", F.inline(F.array(*[F.struct(F.col(c).alias("date"), F.lit(c).alias("_edge")) for c in ("start_date", "end_date")])),
        *[c for c in phases.columns if c not in ("well", "phase_no")],
    )
    opens, closes = F.col("_edge") == "start_date", F.col("_edge") == "end_date"

    def inside(name: str) -> Column:
        return F.col(f"upto_{name}") - F.col(f"before_{name}")

    joined = (
        edges.join(days, ["well", "date"], "left")
        .groupBy(*phases.columns)
        .agg(
            *[F.max(F.when(opens, F.col(f"upto_{c}") - F.col(f"day_{c}"))).alias(f"before_{c}") for c in counted],
            *[F.max(F.when(closes, F.col(f"upto_{c}"))).alias(f"upto_{c}") for c in counted],
            F.max(F.when(closes, F.col("first_md"))).alias("casing_point_m"),
            F.max(F.when(opens, F.col("next_summary"))).alias("_summary"),
        )
        .withColumns({"summary_date": F.col("_summary.date"), "summary": F.col("_summary.summary")})
    )
    mix = F.array(
        *[
            F.struct((-inside(f"n_{i}")).alias("neg"), F.lit(name).alias("label"))
            for i, name in enumerate(PHASE_LABELS)
        ]
    )
    top = F.slice(F.sort_array(F.filter(mix, lambda m: m["neg"] < 0)), 1, 5)
    shown = F.transform(top, lambda m: F.concat(m["label"], F.lit(" "), (-m["neg"]).cast("string")))
    return joined.select(
        *phases.columns,
        inside("n_reports").alias("ddr_days"),
        "casing_point_m",
        inside("n_activities").alias("activities"),
        inside("n_problems").alias("problems"),
        F.array_join(shown, ", ").alias("activity_mix"),
        F.when(F.col("summary_date") <= F.col("end_date"), truncate_text(F.col("summary"), chars)).alias(
            "evidence"
        ),
    )


def depth_reversals(status: DataFrame, tolerance_m: float = 10.0) -> DataFrame:
    """Reports more than ``tolerance_m`` shallower than the last report with a depth."""
    rows = scan(
        status.filter(F.col("md_m").isNotNull()).select("well", "date", "report_no", "md_m"),
        ["well"],
        BY_DAY_AND_ID,
        ["date", "report_no"],
        lag={"from_md": F.col("md_m")},
    )
    return rows.filter(F.col("md_m") < F.col("from_md") - tolerance_m).select(
        "well",
        "date",
        "report_no",
        "from_md",
        F.col("md_m").alias("to_md"),
        (F.col("from_md") - F.col("md_m")).alias("drop_m"),
    )


def phase_distribution(activities: DataFrame) -> DataFrame:
    counts = (
        activities.withColumn("phase", classify_phase(F.col("activity_code")))
        .groupBy("well", "phase")
        .agg(F.count("*").alias("cnt"))
    )
    return share_of_well(counts, "cnt", "pct")


def phase_confidence(phases: DataFrame, status: DataFrame, activities: DataFrame) -> DataFrame:
    n_phases = phases.groupBy("well").agg(F.count("*").alias("n_phases"))
    n_acts = activities.groupBy("well").agg(F.count("*").alias("n_activities"))
    summaries = status.groupBy("well").agg(
        F.max(F.coalesce("summary_24hr", F.lit("")) != "").alias("has_summary")
    )
    merged = (
        summaries.join(n_acts, "well", "full")
        .join(n_phases, "well", "left")
        .fillna({"n_phases": 0, "n_activities": 0, "has_summary": False})
    )
    supported = (F.col("n_activities") > 20) & F.col("has_summary")
    level = (
        F.when(supported & (F.col("n_phases") > 1), "HIGH").when(supported, "MEDIUM").otherwise("LOW")
    )
    return merged.withColumn("confidence", level)


def depth_time_series(status: DataFrame, activities: DataFrame) -> DataFrame:
    """Series behind a depth-over-time chart: depth rows and problem points."""
    depth = status.filter(F.col("md_m").isNotNull()).select(
        "well", F.lit("depth").alias("series"), "date", "md_m", "hole_diameter_in"
    )
    problems = activities.filter((F.col("state") == "problem") & F.col("depth_m").isNotNull()).select(
        "well", F.lit("problem").alias("series"), "date", F.col("depth_m").alias("md_m")
    )
    return union_all([depth, problems])


def hole_runs(status: DataFrame) -> DataFrame:
    """Runs of equal hole size, rows without a size forming runs of their own."""
    rows = status.filter(F.col("md_m").isNotNull()).select(
        "well", "date", "report_no", "md_m", "hole_diameter_in"
    )
    order = ["date", "report_no"]
    with_prev = scan(
        rows,
        ["well"],
        BY_DAY_AND_ID,
        order,
        lag={"_prev": F.struct(F.col("hole_diameter_in").alias("h"))},
    )
    changed = F.col("_prev").isNull() | ~F.col("hole_diameter_in").eqNullSafe(F.col("_prev.h"))
    numbered = scan(
        with_prev.withColumn("_new", changed.cast("int")).drop("_prev"),
        ["well"],
        BY_DAY_AND_ID,
        order,
        total={"run_no": F.col("_new")},
    )
    return numbered.groupBy("well", "run_no").agg(
        F.first("hole_diameter_in").alias("hole_diameter_in"),
        F.count("*").alias("n_rows"),
        F.min("date").alias("from_date"),
        F.max("date").alias("to_date"),
        F.min("md_m").alias("md_min"),
        F.max("md_m").alias("md_max"),
    )


def drilling_phases(
    tables: Mapping[str, DataFrame], date_from: str | None = None, date_to: str | None = None, well: str | None = None
) -> dict[str, DataFrame]:
    """All parts of the report; ``well`` is a name or a pattern, None for every well."""
    tables = of_well(tables, well)
    within = in_dates(F.col("date"), date_from, date_to)
    status = tables["ddr_status"].filter(within)
    activities = tables["ddr_activities"].filter(within)
    phases = hole_phases(status)
    return {
        "phases": phase_details(phases, status, activities),
        "reversals": depth_reversals(status),
        "distribution": phase_distribution(activities),
        "confidence": phase_confidence(phases, status, activities),
    }
