"""Bottom-hole assemblies: runs, drilling parameters per section, comment evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import of_well
from ..functions.numbers import interval_mid, truthy
from ..functions.predicates import mentions_bha, mudlog_quality
from ..functions.text import truncate_text
from .intervals import around, distinct_points, nearest_join, nearest_point
from .ordered import Cut, ranked_within, scan


def bha_runs_list(runs: DataFrame, order: Sequence[str], cut: Cut) -> DataFrame:
    """Runs numbered in start order within each well."""
    return scan(runs, ["well"], cut, order, total={"run_index": F.lit(1)})


def filtered_count(mudlog: DataFrame) -> DataFrame:
    """Rows with ROP, rows kept by the quality filter, and the difference."""
    has_rop = F.col("rop_avg_m_per_hr").isNotNull()
    return (
        mudlog.groupBy("well")
        .agg(F.count_if(has_rop).alias("raw_rows"), F.count_if(mudlog_quality()).alias("kept_rows"))
        .withColumn("filtered_rows", F.col("raw_rows") - F.col("kept_rows"))
    )


def _hole_points(status: DataFrame) -> tuple[DataFrame, list[Column]]:
    points = status.filter(truthy(F.col("md_m")) & truthy(F.col("hole_diameter_in")))
    return points, [F.col("date"), F.col("report_no")]


def mudlog_with_hole(mudlog: DataFrame, status: DataFrame) -> DataFrame:
    """Plausible mudlog rows with the hole size of the report nearest in depth."""
    points, tie = _hole_points(status)
    rows = mudlog.filter(mudlog_quality()).withColumn(
        "md_mid", interval_mid(F.col("md_top_m"), F.col("md_bottom_m"))
    )
    return nearest_join(rows, points, ["well"], "md_mid", "md_m", ["hole_diameter_in"], tie)


def _per_depth_and_lithology(mudlog: DataFrame, status: DataFrame) -> DataFrame:
    """Partial sums per (well, midpoint, lithology) with the hole size looked up afterwards.

    The lookup depends on the midpoint alone, so rows are summed before the join.
    """
    averaged = {
        "rop": "rop_avg_m_per_hr", "wob": "wob_avg_kN", "torque": "torque_avg_kNm",
        "rpm": "rpm_avg", "mw": "mud_weight_sg", "ecd": "ecd_sg",
    }
    sums = [
        part
        for name, col in averaged.items()
        for part in (F.sum(col).alias(f"s_{name}"), F.count(col).alias(f"n_{name}"))
    ]
    partial = (
        mudlog.filter(mudlog_quality())
        .withColumn("md_mid", interval_mid(F.col("md_top_m"), F.col("md_bottom_m")))
        .withColumn("lith", F.coalesce(F.nullif("lith_type", F.lit("")), F.lit("unknown")))
        .groupBy("well", "md_mid", "lith")
        .agg(
            F.count("*").alias("intervals"),
            F.min("md_top_m").alias("md_min"),
            F.max("md_bottom_m").alias("md_max"),
            F.min("rop_avg_m_per_hr").alias("min_rop"),
            F.max("rop_avg_m_per_hr").alias("max_rop"),
            *sums,
        )
    )
    points, tie = _hole_points(status)
    # Partial rows are probes themselves: rows of one depth need no order among them, as they hold no point.
    return around(
        partial.withColumn("_pos", F.col("md_mid")),
        distinct_points(points, ["well"], F.col("md_m"), ["hole_diameter_in"], tie),
        ["well"],
        after=True,
    ).select(*partial.columns, nearest_point()["hole_diameter_in"].alias("hole_diameter_in"))


def mudlog_section_stats(mudlog: DataFrame, status: DataFrame, ref_compat: bool = False) -> DataFrame:
    """Means and extremes per (well, nearest hole size), ranked by mean ROP.

    A mean without values is NULL, or 0 with ``ref_compat``.
    """

    def mean(name: str) -> Column:
        value = F.try_divide(F.sum(f"s_{name}"), F.sum(f"n_{name}"))
        return F.coalesce(value, F.lit(0.0)) if ref_compat else value

    sections = (
        _per_depth_and_lithology(mudlog, status)
        .groupBy("well", "hole_diameter_in")
        .agg(
            F.sum("intervals").alias("intervals"),
            F.min("md_min").alias("md_min"),
            F.max("md_max").alias("md_max"),
            *[mean(n).alias(f"avg_{n}") for n in ("rop", "wob", "torque", "rpm", "mw", "ecd")],
            F.min("min_rop").alias("min_rop"),
            F.max("max_rop").alias("max_rop"),
        )
    )
    return sections


def performance_ranking(sections: DataFrame) -> DataFrame:
    """Sections of a well by mean ROP, fastest first; one row per (well, hole size) comes in."""
    best_first = Window.partitionBy("well").orderBy(F.desc_nulls_last("avg_rop"))
    return sections.withColumn("rop_rank", F.rank().over(best_first))


def lithology_by_section(mudlog: DataFrame, status: DataFrame, k: int = 3) -> DataFrame:
    counts = (
        _per_depth_and_lithology(mudlog, status)
        .groupBy("well", "hole_diameter_in", F.col("lith").alias("lith_type"))
        .agg(F.sum("intervals").alias("cnt"))
    )
    return ranked_within(counts, ["well", "hole_diameter_in"], [F.desc("cnt"), F.asc("lith_type")], k)


def ddr_section_performance(status: DataFrame) -> DataFrame:
    """Reported metres per drilling day for each hole size."""
    return (
        status.filter(truthy(F.col("hole_diameter_in")) & (F.col("dist_drill_m") > 0))
        .groupBy("well", "hole_diameter_in")
        .agg(
            F.count("*").alias("n_days"),
            F.sum("dist_drill_m").alias("total_m"),
            F.avg("dist_drill_m").alias("avg_m_per_day"),
            F.min("md_m").alias("md_min"),
            F.max("md_m").alias("md_max"),
        )
    )


def section_extremes(sections: DataFrame) -> DataFrame:
    """Best and slowest section of wells with more than one; the shallower one on ties."""
    speed = F.col("avg_m_per_day")
    return (
        sections.groupBy("well")
        .agg(
            F.count("*").alias("n_sections"),
            F.min_by("hole_diameter_in", F.struct(-speed, "md_min", "hole_diameter_in")).alias("best_hole"),
            F.max("avg_m_per_day").alias("best_m_per_day"),
            F.min_by("hole_diameter_in", F.struct(speed, "md_min", "hole_diameter_in")).alias("slowest_hole"),
            F.min("avg_m_per_day").alias("slowest_m_per_day"),
        )
        .filter(F.col("n_sections") > 1)
    )


def bha_comments(activities: DataFrame, k: int = 10, chars: int = 180) -> DataFrame:
    """First k comments per well that speak of the assembly, with the number of all of them."""
    hits = activities.filter(mentions_bha())
    order = [F.asc_nulls_last("date"), F.asc_nulls_last("start_ts"), F.asc("event_id")]
    first = ranked_within(hits, ["well"], order, k).select(
        "well", "rank_no", "date", "depth_m", "activity_code", "event_id",
        truncate_text(F.col("comments"), chars).alias("comment"),
    )
    mentions = hits.groupBy("well").agg(F.count("*").alias("n_mentions"))
    return first.join(mentions, "well")


def bha_confidence(runs: DataFrame, mudlog: DataFrame, wells: DataFrame) -> DataFrame:
    n_runs = runs.groupBy("well").agg(F.count("*").alias("bha_runs"))
    n_logs = mudlog.groupBy("well").agg(F.count_if(mudlog_quality()).alias("mudlog_intervals"))
    merged = (
        wells.select("well").distinct().join(n_runs, "well", "left").join(n_logs, "well", "left")
    ).fillna(0, ["bha_runs", "mudlog_intervals"])
    has_runs = F.col("bha_runs") > 0
    level = (
        F.when(has_runs & (F.col("mudlog_intervals") > 0), "HIGH").when(has_runs, "MEDIUM").otherwise("LOWER")
    )
    return merged.withColumn("confidence", level)


def runs_by_start(runs: DataFrame, tie: Sequence[str] = ("run_name",)) -> DataFrame:
    """Runs numbered by start time within each well, those without a time last, equal times by ``tie``."""
    timed = runs.withColumn("_start", F.coalesce(F.col("start_time").cast("string"), F.lit("~")))
    by_day = Cut(lambda c: F.substring(c, 1, 10))
    return bha_runs_list(timed, ["_start", *tie], by_day).drop("_start")


def bha_configurations(tables: Mapping[str, DataFrame], well: str | None = None) -> dict[str, DataFrame]:
    """All parts of the report; ``well`` is a name or a pattern, None for every well."""
    tables = of_well(tables, well)
    mudlog, status = tables["witsml_mudlog"], tables["ddr_status"]
    sections = ddr_section_performance(status)
    return {
        "runs": runs_by_start(tables["witsml_bha_runs"]),
        "filtered": filtered_count(mudlog),
        "sections": performance_ranking(mudlog_section_stats(mudlog, status)),
        "lithology": lithology_by_section(mudlog, status),
        "ddr_sections": sections,
        "extremes": section_extremes(sections),
        "comments": bha_comments(tables["ddr_activities"]),
        "confidence": bha_confidence(tables["witsml_bha_runs"], mudlog, status),
    }
