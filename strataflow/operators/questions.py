"""Field questions answered by combining the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import interval_mid, truthy
from ..functions.predicates import mudlog_quality
from .benchmarks import mudlog_in_sections
from .intervals import DEPTH_BIN_M
from .issues import formation_at
from .ordered import by_depth, running_counts, scan, union_all, value_range


def rank_wells(per_well: DataFrame, col: str, out: str) -> DataFrame:
    """Position of each row by ``col``, largest first, NULL last, ties by well name.

    Rows are ranked inside ranges of values; the ranges, bounded in number, carry the offset.
    """
    # The last range is that of NULL.
    ranged = per_well.withColumn("_range", F.coalesce(-value_range(F.col(col)), F.lit((1 << 62)).cast("long")))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_range").orderBy(F.desc_nulls_last(col), F.asc("well"))
    return (
        ranged.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, "_range")
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_range", "_inside", "_offset")
    )


def npt_ranking(breakdown: DataFrame) -> DataFrame:
    """Wells by share of non-productive time."""
    return rank_wells(breakdown.select("well", "npt_hrs", "total_hrs", "npt_pct"), "npt_pct", "npt_rank")


def weather_by_month(timed: DataFrame) -> DataFrame:
    """Hours lost to weather per well and calendar month."""
    return (
        timed.filter(F.col("cause") == "Weather")
        .groupBy("well", F.substring("date", 6, 2).alias("month"))
        .agg(F.sum("duration_hrs").alias("hrs"), F.count("*").alias("events"))
    )


def campaigns(status: DataFrame, gap_days: int = 30) -> DataFrame:
    """Stretches of reports without an idle gap of more than ``gap_days``.

    Reports are reduced to days first: the windows run over the calendar only.
    """
    days = status.groupBy("well", "date").agg(
        F.count("*").alias("reports"), F.min("md_m").alias("lo"), F.max("md_m").alias("hi")
    )
    in_order = Window.partitionBy("well").orderBy("date")
    idle = F.datediff(F.to_date("date"), F.to_date(F.lag("date").over(in_order)))
    starts = days.withColumn("_idle", idle).withColumn(
        "_new", F.when(F.col("_idle").isNull() | (F.col("_idle") > gap_days), 1).otherwise(0)
    )
    numbered = starts.withColumn("campaign_no", F.sum("_new").over(in_order))
    return numbered.groupBy("well", "campaign_no").agg(
        F.min("date").alias("from_date"),
        F.max("date").alias("to_date"),
        F.sum("reports").alias("reports"),
        F.min("lo").alias("md_min"),
        F.max("hi").alias("md_max"),
        F.max(F.when(F.col("_new") == 1, F.col("_idle"))).alias("idle_days_before"),
    )


def flat_stretches(status: DataFrame, max_gain_m: float = 5.0, min_days: int = 2) -> DataFrame:
    """Runs of days whose deepest depth moves by at most ``max_gain_m`` from day to day."""
    days = status.filter(truthy(F.col("md_m"))).groupBy("well", "date").agg(F.max("md_m").alias("md"))
    in_order = Window.partitionBy("well").orderBy("date")
    moved = days.withColumn("_gain", F.col("md") - F.lag("md").over(in_order)).withColumn(
        "_new", F.when(F.abs("_gain") <= max_gain_m, 0).otherwise(1)
    )
    return (
        moved.withColumn("stretch_no", F.sum("_new").over(in_order))
        .groupBy("well", "stretch_no")
        .agg(
            F.min("date").alias("from_date"),
            F.max("date").alias("to_date"),
            F.count("*").alias("days"),
            F.min("md").alias("md_min"),
            F.max("md").alias("md_max"),
        )
        .filter(F.col("days") >= min_days)
    )


def _rop_by_mid(mudlog: DataFrame, *extra: str) -> DataFrame:
    """Plausible intervals summed per (well, midpoint): what a depth lookup needs."""
    return (
        mudlog.filter(mudlog_quality())
        .withColumn("md_mid", interval_mid(F.col("md_top_m"), F.col("md_bottom_m")))
        .groupBy("well", "md_mid", *extra)
        .agg(F.count("*").alias("n"), F.sum("rop_avg_m_per_hr").alias("s"))
    )


def rop_by_formation(mudlog: DataFrame, tops: DataFrame) -> DataFrame:
    """Mean ROP per well and formation."""
    located = formation_at(_rop_by_mid(mudlog), tops, "md_mid")
    return (
        located.groupBy("well", "formation")
        .agg(F.sum("n").alias("intervals"), (F.sum("s") / F.sum("n")).alias("avg_rop"))
    )


def rop_by_lithology(mudlog: DataFrame) -> DataFrame:
    return (
        mudlog.filter(mudlog_quality())
        .groupBy("lith_type")
        .agg(
            F.count("*").alias("intervals"),
            F.avg("rop_avg_m_per_hr").alias("avg_rop"),
            F.avg("wob_avg_kN").alias("avg_wob"),
        )
    )


def run_performance(runs: DataFrame, mudlog: DataFrame, run_id: str = "run_no", width: float = DEPTH_BIN_M) -> DataFrame:
    """Intervals, mean ROP and WOB whose midpoint lies inside each assembly run.

    Runs overlap freely, so a join would list every (run, interval) pair.  Running sums in depth
    order give the same: value at the end of the run minus value before its start.
    """
    def fixed(col: str):
        return F.sum(F.col(col).cast("decimal(20,9)")).cast("decimal(38,9)")

    points = (
        mudlog.filter(mudlog_quality())
        .withColumn("_pos", interval_mid(F.col("md_top_m"), F.col("md_bottom_m")))
        .groupBy("well", "_pos")
        .agg(
            F.count("*").alias("_n"), fixed("rop_avg_m_per_hr").alias("_r"),
            fixed("wob_avg_kN").alias("_w"), F.count("wob_avg_kN").alias("_wn"),
        )
        .withColumn("_kind", F.lit(1))
    )
    run = ["well", run_id, "md_start_m", "md_stop_m"]
    # Equal runs are swept once; both edges of a run carry its name, so no join leads back to it.
    real = runs.filter(F.col("md_start_m") <= F.col("md_stop_m")).groupBy(*run).agg(F.count("*").alias("_copies"))
    edges = real.select(
        *run,
        "_copies",
        F.inline(
            F.array(
                F.struct(F.col("md_start_m").alias("_pos"), F.lit(0).alias("_kind")),
                F.struct(F.col("md_stop_m").alias("_pos"), F.lit(2).alias("_kind")),
            )
        ),
    )
    zero = F.lit(0).cast("decimal(38,9)")
    # Edges add nothing, so edges that share a place need no order among themselves.
    swept = scan(
        union_all([points, edges]),
        ["well"],
        by_depth(width),
        ["_pos", "_kind"],
        total={
            "n": F.coalesce("_n", F.lit(0)), "wn": F.coalesce("_wn", F.lit(0)),
            "r": F.coalesce("_r", zero), "w": F.coalesce("_w", zero),
        },
    ).filter(F.col("_kind") != 1)

    def inside(c: str):
        return F.max(F.when(F.col("_kind") == 2, F.col(c))) - F.max(F.when(F.col("_kind") == 0, F.col(c)))

    found = swept.groupBy(*run, "_copies").agg(*[inside(c).alias(c) for c in ("n", "wn", "r", "w")])
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(
        *run,
        F.col("n").alias("intervals"),
        F.try_divide(F.col("r").cast("double"), F.col("n").cast("double")).alias("avg_rop"),
        F.try_divide(F.col("w").cast("double"), F.col("wn").cast("double")).alias("avg_wob"),
    )


def parameter_correlations(mudlog: DataFrame) -> DataFrame:
    """Correlation of ROP with rotation, weight and mud weight per well."""
    return (
        mudlog.filter(mudlog_quality())
        .groupBy("well")
        .agg(
            F.count("*").alias("intervals"),
            F.corr("rop_avg_m_per_hr", "rpm_avg").alias("rop_rpm"),
            F.corr("rop_avg_m_per_hr", "wob_avg_kN").alias("rop_wob"),
            F.corr("rop_avg_m_per_hr", "mud_weight_sg").alias("rop_mw"),
        )
    )


def section_means(sectioned: DataFrame) -> DataFrame:
    return sectioned.groupBy("well", "hole_diameter_in").agg(
        F.avg("wob_avg_kN").alias("wob_mean"),
        F.stddev_pop("wob_avg_kN").alias("wob_sd"),
        F.avg("torque_avg_kNm").alias("torque_mean"),
        F.stddev_pop("torque_avg_kNm").alias("torque_sd"),
        F.avg("rop_avg_m_per_hr").alias("rop_mean"),
    )


def hard_intervals(mudlog: DataFrame, status: DataFrame, sigmas: float = 1.0) -> DataFrame:
    """Intervals with high weight and torque for their section, yet below half its mean ROP."""
    rows = mudlog_in_sections(mudlog, status)
    means = section_means(rows)
    joined = rows.join(means, ["well", "hole_diameter_in"])
    return joined.filter(
        (F.col("wob_avg_kN") > F.col("wob_mean") + sigmas * F.col("wob_sd"))
        & (F.col("torque_avg_kNm") > F.col("torque_mean") + sigmas * F.col("torque_sd"))
        & (F.col("rop_avg_m_per_hr") < 0.5 * F.col("rop_mean"))
    )


def change_points(mudlog: DataFrame, tops: DataFrame, value: str = "dxc", jump: float = 0.05, step_m: float = 10.0) -> DataFrame:
    """Depth steps whose mean differs from the step above by more than ``jump``, with their formation.

    Steps are aggregates: a well has as many as its depth allows.
    """
    steps = (
        mudlog.filter(F.col(value).isNotNull())
        .groupBy("well", (F.floor(F.col("md_top_m") / step_m) * step_m).cast("double").alias("step_md"))
        .agg(F.avg(value).alias("step_mean"), F.count("*").alias("intervals"))
    )
    in_order = Window.partitionBy("well").orderBy("step_md")
    moved = steps.withColumn("change", F.col("step_mean") - F.lag("step_mean").over(in_order))
    return formation_at(moved.filter(F.abs("change") > jump), tops, "step_md")


def gas_near_kicks(activities: DataFrame, mudlog: DataFrame, tolerance_m: float = 10.0, width: float = 1.0) -> DataFrame:
    """Well-control activities with the highest methane within ``tolerance_m`` of their depth.

    Readings are reduced to the highest of each depth, and to the highest of each metre.  Metres that lie
    within reach as a whole are answered by their maximum; in the two or three that are cut by the
    reach, every depth is measured.
    """
    mid = interval_mid(F.col("md_top_m"), F.col("md_bottom_m"))
    points = (
        mudlog.filter(F.col("methane_avg_ppm").isNotNull())
        .groupBy("well", mid.alias("mid"))
        .agg(F.max("methane_avg_ppm").alias("peak"))
        .withColumn("bin", F.floor(F.col("mid") / width))
    )
    bins = points.groupBy("well", "bin").agg(F.max("peak").alias("peak"))
    kicks = activities.filter(F.col("activity_code").startswith("well_control") & truthy(F.col("depth_m")))
    lowest, highest = (F.floor((F.col("depth_m") + F.lit(side * tolerance_m)) / width) for side in (-1, 1))
    asked = kicks.select("well", "depth_m").distinct().select(
        "well", "depth_m", F.explode(F.sequence(lowest - 1, highest + 1)).alias("bin")
    )
    start, stop = F.col("bin") * width, (F.col("bin") + 1) * width
    # A metre counts as whole only with some room, so that rounding never decides.
    inside = (start >= F.col("depth_m") - tolerance_m + 1e-6) & (stop <= F.col("depth_m") + tolerance_m - 1e-6)
    whole = asked.filter(inside).join(bins, ["well", "bin"]).select("well", "depth_m", "peak")
    edges = (
        asked.filter(~inside)
        .join(points, ["well", "bin"])
        .filter(F.abs(F.col("mid") - F.col("depth_m")) <= tolerance_m)
        .select("well", "depth_m", "peak")
    )
    near = whole.union(edges).groupBy("well", "depth_m").agg(F.max("peak").alias("max_ch4"))
    return kicks.select("event_id", "well", "date", "depth_m").join(near, ["well", "depth_m"], "left")


def npt_vs_production(breakdown: DataFrame, production: DataFrame) -> DataFrame:
    """Downtime share beside cumulative oil, and their correlation over the producing wells."""
    both = breakdown.select("well", "npt_pct").join(production.select("well", "cum_oil"), "well")
    overall = both.agg(F.corr("npt_pct", "cum_oil").alias("c")).scalar()
    return both.withColumn("field_corr", overall)


def rop_percentiles(mudlog: DataFrame, status: DataFrame) -> DataFrame:
    """P10, P50 and P90 of ROP per section by rank: the smallest value with that share at or below it."""
    key = ["well", "hole_diameter_in"]
    counts = running_counts(mudlog_in_sections(mudlog, status).select(*key, "rop_avg_m_per_hr"), key, "rop_avg_m_per_hr")

    def percentile(percent: int, name: str):
        reached = F.col("upto") * 100 >= F.col("total") * percent
        return F.min(F.when(reached, F.col("rop_avg_m_per_hr"))).alias(name)

    return counts.groupBy(*key).agg(
        F.sum("n").alias("intervals"), percentile(10, "p10"), percentile(50, "p50"), percentile(90, "p90")
    )


def progress_vs_rop(status: DataFrame, mudlog: DataFrame) -> DataFrame:
    """Daily progress beside the mean ROP of the drilled depth range of each hole section."""
    daily = (
        status.filter(F.col("hole_diameter_in").isNotNull() & (F.col("dist_drill_m") > 0))
        .groupBy("well", "hole_diameter_in", "date")
        .agg(F.sum("dist_drill_m").alias("dist_m"))
        .groupBy("well", "hole_diameter_in")
        .agg(F.avg("dist_m").alias("m_per_day"), F.count("*").alias("days"))
    )
    rop = (
        mudlog_in_sections(mudlog, status)
        .groupBy("well", "hole_diameter_in")
        .agg(F.avg("rop_avg_m_per_hr").alias("avg_rop"))
    )
    hours = F.col("m_per_day") / F.col("avg_rop")
    return daily.join(rop, ["well", "hole_diameter_in"]).withColumn("drilling_hrs_per_day", hours)


def delivery_time(meta: DataFrame, start: str = "spud_date", end: str = "drill_complete_date") -> DataFrame:
    """Days from the earliest spud to the latest completion of each well."""
    def day(c: str):
        return F.substring(c, 1, 10).try_cast("date")

    spans = meta.groupBy("well").agg(F.min(day(start)).alias("spud"), F.max(day(end)).alias("complete"))
    return spans.filter(F.col("spud").isNotNull() & F.col("complete").isNotNull()).select(
        "well",
        F.col("spud").cast("string").alias("spud"),
        F.col("complete").cast("string").alias("complete"),
        F.datediff("complete", "spud").alias("delivery_days"),
    )
