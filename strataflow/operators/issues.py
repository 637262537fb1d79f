"""Operational issues: categories, contributing factors, mud properties, trend, evidence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.activity import issue_category
from ..functions.names import of_well
from ..functions.numbers import duration_hrs, truthy
from ..functions.predicates import in_dates, is_issue, is_problem_summary, mudlog_quality
from ..functions.text import truncate_text
from .intervals import asof_join, interval_mean, interval_sweep
from .ordered import ranked_within

def _time_order() -> list[Column]:
    return [F.asc_nulls_last("date"), F.asc_nulls_last("start_ts"), F.asc_nulls_last("event_id")]


def issue_rows(activities: DataFrame) -> DataFrame:
    """Problem, downtime and well-control activities with their category."""
    return activities.filter(is_issue()).withColumn(
        "category", issue_category(F.col("activity_code"), F.col("state_detail"), F.col("comments"))
    )


def issue_counts(activities: DataFrame) -> DataFrame:
    """Issues per category and their share of all activities of the well, in one pass."""
    tagged = activities.withColumn(
        "category",
        F.when(
            is_issue(), issue_category(F.col("activity_code"), F.col("state_detail"), F.col("comments"))
        ),
    )
    counts = tagged.groupBy("well", "category").agg(F.count("*").alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy("well"))
    return (
        counts.withColumn("total_activities", total)
        .filter(F.col("category").isNotNull())
        .withColumn("pct_of_activities", F.col("cnt") / F.col("total_activities") * 100.0)
    )


def first_events(issues: DataFrame, k: int | None = 3, chars: int | None = 200) -> DataFrame:
    """First k events of each category, all for None."""
    return ranked_within(issues, ["well", "category"], _time_order(), k).select(
        "well", "category", "rank_no", "date", "depth_m", "event_id",
        truncate_text(F.coalesce("comments", F.lit("")), chars).alias("comment"),
    )


def issue_timeline(issues: DataFrame, k: int | None = 25, chars: int | None = 150) -> DataFrame:
    """First k issues of each well in time order, all for None."""
    return ranked_within(issues, ["well"], _time_order(), k).select(
        "well", "rank_no", "date", "depth_m", "category", "event_id",
        duration_hrs(F.col("start_ts"), F.col("end_ts")).alias("duration_hrs"),
        truncate_text(F.coalesce("comments", F.lit("")), chars).alias("comment"),
    )


def last_per_day(rows: DataFrame, value: str, tie: str) -> DataFrame:
    """Value of the last row of each (well, date); a missing value there stays missing."""
    return rows.groupBy("well", "date").agg(
        F.max_by(F.struct(value), F.col(tie)).getField(value).alias(value)
    )


def formation_at(probes: DataFrame, tops: DataFrame, depth: str = "depth_m") -> DataFrame:
    """Formation of each row's depth: the last top at or above it."""
    return asof_join(
        probes, tops, ["well"], depth, "md_m", ["surface_name"], [F.col("top_no")]
    ).withColumnRenamed("surface_name", "formation")


def rop_at_depths(probes: DataFrame, mudlog: DataFrame, depth: str = "depth_m") -> DataFrame:
    """Mean ROP of the intervals at each distinct depth, else that of the nearest interval."""
    plausible = mudlog.filter(mudlog_quality(with_torque=False))
    return interval_mean(
        probes.filter(truthy(F.col(depth))),
        plausible,
        ["well"],
        depth,
        "md_top_m",
        "md_bottom_m",
        "rop_avg_m_per_hr",
    )


def _joined_set(col: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(col)), "|")


def contributing_factors(
    issues: DataFrame, status: DataFrame, fluids: DataFrame, tops: DataFrame, mudlog: DataFrame, min_events: int = 2
) -> DataFrame:
    """Depths, hole sizes, formations, mud weight and ROP around each category of issues.

    Issues are counted per (category, date) and per (category, depth) before anything meets them.  One
    sweep in depth order answers both the formation and the ROP of a depth.
    """
    key = ["well", "category"]
    by_day = issues.groupBy(*key, "date").agg(F.count("*").alias("n"))
    hole = F.when(truthy(F.col("hole_diameter_in")), F.col("hole_diameter_in"))
    density = F.when(truthy(F.col("density_gcc")), F.col("density_gcc"))
    daily = (
        by_day.join(last_per_day(status, "hole_diameter_in", "report_no"), ["well", "date"], "left")
        .join(last_per_day(fluids, "density_gcc", "sample_no"), ["well", "date"], "left")
        .groupBy(*key)
        .agg(
            F.sum("n").alias("events"),
            F.array_join(F.transform(F.sort_array(F.collect_set(hole)), lambda h: h.cast("string")), "|").alias("holes"),
            F.min(density).alias("density_min"),
            F.max(density).alias("density_max"),
        )
        .filter(F.col("events") >= min_events)
    )
    plausible = mudlog.filter(mudlog_quality(with_torque=False))
    by_depth = issues.filter(truthy(F.col("depth_m"))).groupBy(*key, F.col("depth_m").alias("_pos")).agg(F.count("*").alias("n"))
    picks = tops.filter(F.col("md_m").isNotNull()).select(
        "well", F.col("md_m").alias("_pos"), F.struct("surface_name").alias("_payload"), F.col("top_no").alias("_tie")
    )
    swept = interval_sweep(
        by_depth, plausible, ["well"], "md_top_m", "md_bottom_m", "rop_avg_m_per_hr", points=picks, also=["category"]
    )
    found = F.when(truthy(F.col("mean")), F.col("n"))
    depths = swept.groupBy(*key).agg(
        F.min("_pos").alias("depth_min"),
        F.max("_pos").alias("depth_max"),
        _joined_set(F.col("known.surface_name")).alias("formations"),
        F.try_divide(F.sum(found * F.col("mean")), F.sum(found)).alias("rop_at_issues"),
    )
    well_rop = plausible.groupBy("well").agg(F.avg("rop_avg_m_per_hr").alias("rop_well"))
    ratio = F.col("rop_at_issues") / F.col("rop_well")
    return (
        daily.join(depths, key, "left")
        .join(well_rop, "well", "left")
        .withColumn(
            "rop_vs_well",
            F.when(ratio.isNull(), F.lit(None)).when(ratio > 1.1, "above").when(ratio < 0.9, "below").otherwise("near"),
        )
        .fillna("", ["holes", "formations"])
    )


def mud_on_problem_days(fluids: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fluid rows on days with issues, and on the other days."""
    days = issues.select("well", "date").distinct()
    return (
        fluids.join(days, ["well", "date"], "left_semi"),
        fluids.join(days, ["well", "date"], "left_anti"),
    )


def mud_problem_vs_normal(fluids: DataFrame, issues: DataFrame) -> DataFrame:
    """Mean density, PV and YP on issue days against other days; zeros are left out."""
    properties = ("density_gcc", "pv_mPas", "yp_Pa")
    # Per-day sums first: the join then meets one row per (well, date).
    daily = fluids.groupBy("well", "date").agg(
        *[
            agg
            for p in properties
            for agg in (
                F.sum(F.when(truthy(F.col(p)), F.col(p))).alias(f"s_{p}"),
                F.count_if(truthy(F.col(p))).alias(f"n_{p}"),
            )
        ]
    )
    days = issues.select("well", "date").distinct().withColumn("problem", F.lit(True))
    flagged = daily.join(days, ["well", "date"], "left").fillna(False, ["problem"])
    long = flagged.select(
        "well",
        "problem",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(p).alias("property"), F.col(f"s_{p}").alias("s"), F.col(f"n_{p}").alias("n"))
                    for p in properties
                ]
            )
        ),
    )

    def side(flag: bool, col: str) -> Column:
        return F.sum(F.when(F.col("problem") == flag, F.col(col)))

    compared = (
        long.groupBy("well", "property")
        .agg(
            side(True, "n").alias("n_problem"),
            side(False, "n").alias("n_normal"),
            F.try_divide(side(True, "s"), side(True, "n")).alias("avg_problem"),
            F.try_divide(side(False, "s"), side(False, "n")).alias("avg_normal"),
        )
        .filter((F.col("n_problem") > 0) & (F.col("n_normal") > 0))
        .withColumn("diff_pct", (F.col("avg_problem") - F.col("avg_normal")) / F.col("avg_normal") * 100.0)
    )
    return compared.withColumn("notable", F.abs("diff_pct") > 5)


def issue_trend(issues: DataFrame, by_time: bool = False) -> DataFrame:
    """Issues in the first and the second half, for wells with more than five.

    Halves split the events; with ``by_time`` they split the span of days instead.
    Days are counted first, so the running counts run over the calendar only.
    """
    daily = issues.groupBy("well", "date").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("well")
    upto = whole.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = daily.withColumns(
        {
            "upto": F.sum("n").over(upto),
            "total": F.sum("n").over(whole),
            "lo": F.to_date(F.min("date").over(whole)),
            "hi": F.to_date(F.max("date").over(whole)),
        }
    ).filter(F.col("total") > 5)
    date, start = F.col("date"), F.col("upto") - F.col("n")
    if by_time:
        early = F.datediff(F.to_date("date"), F.col("lo")) * 2 < F.datediff("hi", "lo")
        n_first = F.coalesce(F.sum(F.when(early, F.col("n"))), F.lit(0))
        first_to = F.max(F.when(early, date))
        second_from = F.min(F.when(~early, date))
    else:
        half = F.floor(F.col("total") / 2)
        n_first = F.max(half)
        # Days that hold the last event of the first half and the first event of the second.
        first_to = F.max(F.when((start < half) & (F.col("upto") >= half), date))
        second_from = F.min(F.when((start < half + 1) & (F.col("upto") >= half + 1), date))
    halves = days.groupBy("well").agg(
        F.max("total").alias("total"),
        n_first.alias("first_half"),
        F.min("date").alias("first_from"),
        first_to.alias("first_to"),
        second_from.alias("second_from"),
        F.max("date").alias("second_to"),
    ).withColumn("second_half", F.col("total") - F.col("first_half"))
    trend = (
        F.when(F.col("second_half") > F.col("first_half") * 1.3, "INCREASING")
        .when(F.col("second_half") < F.col("first_half") * 0.7, "DECREASING")
        .otherwise("STABLE")
    )
    return halves.withColumn("trend", trend)


def problem_summaries(status: DataFrame, k: int | None = 5, chars: int | None = 200) -> DataFrame:
    """First k daily summaries per well that speak of a problem, all for None."""
    order = [F.asc_nulls_last("date"), F.asc_nulls_last("report_no")]
    return ranked_within(status.filter(is_problem_summary()), ["well"], order, k).select(
        "well", "rank_no", "date", "report_no", "md_m", truncate_text(F.col("summary_24hr"), chars).alias("excerpt")
    )


def operational_issues(
    tables: Mapping[str, DataFrame], date_from: str | None = None, date_to: str | None = None, well: str | None = None
) -> dict[str, DataFrame]:
    """All parts of the report; ``well`` is a name or a pattern, None for every well."""
    tables = of_well(tables, well)
    within = in_dates(F.col("date"), date_from, date_to)
    activities = tables["ddr_activities_timed"].filter(within)
    status, fluids = tables["ddr_status"].filter(within), tables["ddr_fluids"].filter(within)
    issues = issue_rows(activities)
    return {
        "summary": issue_counts(activities),
        "first_events": first_events(issues),
        "factors": contributing_factors(
            issues, status, fluids, tables["formation_tops"], tables["witsml_mudlog"]
        ),
        "mud": mud_problem_vs_normal(fluids, issues),
        "trend": issue_trend(issues),
        "timeline": issue_timeline(issues),
        "summaries": problem_summaries(status),
    }
