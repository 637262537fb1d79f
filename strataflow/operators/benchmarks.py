"""Field-wide benchmarks across wells and hole sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import interval_mid, zscore
from ..functions.predicates import in_wells, mentions_fishing, mentions_severe, mudlog_quality
from .intervals import assign_to_window


def top_bottom(df: DataFrame, order: list[Column], reverse: list[Column], k: int = 5) -> DataFrame:
    """First k rows, and the last k in reverse if there are more than k rows.

    ``order`` must be total and ``reverse`` its exact opposite.  Two top-k sorts, no full sort.
    """

    def band(label: str, keys: list[Column]) -> DataFrame:
        # The unpartitioned window numbers the k rows that are left, no more.
        return (
            df.orderBy(*keys)
            .limit(k)
            .withColumn("rank_no", F.row_number().over(Window.orderBy(*keys)))
            .withColumn("band", F.lit(label))
        )

    # The bottom is shown only if there are more than k rows: the last of k + 1 tells.
    more = df.limit(k + 1).agg((F.count("*") > k).alias("more")).scalar()
    return band("top", order).unionByName(band("bottom", reverse).filter(more))


def daily_progress(status: DataFrame, wells=None, hole_size_in: float | None = None) -> DataFrame:
    """Metres per drilling day of each (well, hole) with at least two drilling days."""
    keep = (
        F.col("hole_diameter_in").isNotNull()
        & (F.coalesce("dist_drill_m", F.lit(0.0)) > 0)
        & in_wells(F.col("well"), wells)
    )
    if hole_size_in is not None:
        keep = keep & (F.col("hole_diameter_in") == hole_size_in)
    per_day = (
        status.filter(keep)
        .groupBy("well", "hole_diameter_in", "date")
        .agg(F.sum("dist_drill_m").alias("dist_m"))
    )
    return (
        per_day.groupBy("well", "hole_diameter_in")
        .agg(
            F.avg("dist_m").alias("avg_daily_m"),
            F.count("*").alias("drilling_days"),
            F.sum("dist_m").alias("total_m"),
        )
        .filter(F.col("drilling_days") >= 2)
    )


def section_windows(status: DataFrame, wells=None, hole_size_in: float | None = None) -> DataFrame:
    """Depth range of each (well, hole size)."""
    keep = F.col("hole_diameter_in").isNotNull() & in_wells(F.col("well"), wells)
    if hole_size_in is not None:
        keep = keep & (F.col("hole_diameter_in") == hole_size_in)
    return (
        status.filter(keep)
        .groupBy("well", "hole_diameter_in")
        .agg(F.min("md_m").alias("md_min"), F.max("md_m").alias("md_max"))
    )


def mudlog_in_sections(mudlog: DataFrame, status: DataFrame, wells=None, hole_size_in=None) -> DataFrame:
    """Plausible mudlog intervals with the hole section their midpoint lies in."""
    rows = mudlog.filter(mudlog_quality() & in_wells(F.col("well"), wells))
    return assign_to_window(
        rows,
        section_windows(status, wells, hole_size_in),
        ["well"],
        interval_mid(F.col("md_top_m"), F.col("md_bottom_m")),
        "md_min",
        "md_max",
        "hole_diameter_in",
        extra=["md_min", "md_max"],
    )


def section_performance(
    mudlog: DataFrame, status: DataFrame, wells=None, hole_size_in=None, min_intervals: int = 10
) -> DataFrame:
    """Mean parameters per section and difficulty = z(WOB) + z(torque) - z(ROP).

    A mean without values counts as 0, also in the z-scores.
    """

    def mean(col: str, name: str) -> Column:
        return F.coalesce(F.avg(col), F.lit(0.0)).alias(name)

    sections = (
        mudlog_in_sections(mudlog, status, wells, hole_size_in)
        .groupBy("well", "hole_diameter_in", "md_min", "md_max")
        .agg(
            F.count("*").alias("intervals"),
            mean("rop_avg_m_per_hr", "avg_rop"),
            mean("wob_avg_kN", "avg_wob"),
            mean("torque_avg_kNm", "avg_torque"),
            mean("rpm_avg", "avg_rpm"),
            mean("mud_weight_sg", "avg_mw"),
            mean("ecd_sg", "avg_ecd"),
            mean("methane_avg_ppm", "avg_ch4"),
        )
        .filter(F.col("intervals") >= min_intervals)
    )
    # One row of field statistics as a scalar subquery: nothing is joined.  It reads every column, so that
    # its plan up to here is that of the sections and their exchange is run once.
    field = sections.agg(
        F.struct(
            F.count("*").alias("n"),
            F.max(F.struct(*sections.columns)).alias("_all"),
            *[F.avg(c).alias(f"{c}_m") for c in ("avg_rop", "avg_wob", "avg_torque")],
            *[F.stddev_pop(c).alias(f"{c}_s") for c in ("avg_rop", "avg_wob", "avg_torque")],
        ).alias("f")
    ).scalar()

    def z(col: str) -> Column:
        return zscore(F.col(col), F.col(f"_f.{col}_m"), F.col(f"_f.{col}_s"), F.col("_f.n"))

    return (
        sections.withColumn("_f", field)
        .withColumn("difficulty_index", z("avg_wob") + z("avg_torque") - z("avg_rop"))
        .drop("_f")
    )


def formation_window(tops: DataFrame, formation: str, wells=None) -> DataFrame:
    """Depth window of a formation per well: its tops, its bases, else the next pick, else +400 m."""
    tops = tops.filter(in_wells(F.col("well"), wells))
    name = F.lower("surface_name")
    named = tops.filter(name.contains(formation.lower()))
    picked = (
        named.groupBy("well")
        .agg(
            F.coalesce(F.min(F.when(name.contains("top"), F.col("md_m"))), F.min("md_m")).alias("top_md"),
            F.max(F.when(name.contains("base"), F.col("md_m"))).alias("_base"),
        )
        .filter(F.col("top_md").isNotNull())
    )
    following = (
        tops.select("well", "md_m")
        .join(picked, "well")
        .groupBy("well", "top_md", "_base")
        .agg(F.min(F.when(F.col("md_m") > F.col("top_md"), F.col("md_m"))).alias("_next"))
    )
    base = F.coalesce("_base", "_next", F.col("top_md") + 400.0)
    return following.select(
        "well",
        "top_md",
        F.when(base <= F.col("top_md"), F.col("top_md") + 400.0).otherwise(base).alias("base_md"),
    )


def rows_in_formation(mudlog: DataFrame, tops: DataFrame, formation: str, wells=None) -> DataFrame:
    """Mudlog intervals wholly inside the formation window of their well."""
    window = formation_window(tops, formation, wells)
    return mudlog.join(window, "well").filter(
        (F.col("md_top_m") >= F.col("top_md")) & (F.col("md_bottom_m") <= F.col("base_md"))
    )


def gas_response(mudlog: DataFrame, tops: DataFrame, formation: str = "Hugin", wells=None) -> DataFrame:
    """Methane and ethane inside the formation, with its most frequent lithology."""
    has_gas = F.col("methane_avg_ppm").isNotNull()
    # Counts per lithology are the only shuffle; both results follow from them.
    per_lith = (
        rows_in_formation(mudlog, tops, formation, wells)
        .groupBy("well", "top_md", "base_md", "lith_type")
        .agg(
            F.count("*").alias("_n"),
            F.count_if(has_gas).alias("_gas_n"),
            F.max("methane_avg_ppm").alias("_max_ch4"),
            F.max(F.when(has_gas, F.col("ethane_avg_ppm"))).alias("_max_c2"),
            F.sum("methane_avg_ppm").alias("_sum_ch4"),
            F.sum(F.when(has_gas, F.col("ethane_avg_ppm"))).alias("_sum_c2"),
            F.count(F.when(has_gas, F.col("ethane_avg_ppm"))).alias("_n_c2"),
        )
    )
    mode = F.min_by(
        "lith_type", F.when(F.col("lith_type").isNotNull(), F.struct(-F.col("_n"), "lith_type"))
    )
    return (
        per_lith.groupBy("well", "top_md", "base_md")
        .agg(
            F.sum("_gas_n").alias("intervals"),
            F.coalesce(F.max("_max_ch4"), F.lit(0.0)).alias("max_ch4"),
            F.coalesce(F.max("_max_c2"), F.lit(0.0)).alias("max_c2"),
            F.try_divide(F.sum("_sum_ch4"), F.sum("_gas_n")).alias("avg_ch4"),
            F.try_divide(F.sum("_sum_c2"), F.sum("_n_c2")).alias("avg_c2"),
            F.coalesce(mode, F.lit("unknown")).alias("dominant_lith"),
        )
        .filter(F.col("intervals") > 0)
        .fillna(0.0, ["avg_ch4", "avg_c2"])
    )


def perforation_counts(perforations: DataFrame) -> DataFrame:
    return perforations.groupBy("well").agg(
        F.count("*").alias("perf_count"), F.max("md_base_m").alias("deepest_perf_md")
    )


def risk(activities: DataFrame, perforations: DataFrame, wells=None) -> DataFrame:
    """Composite risk score per well from severe words, kicks, fishing and interruptions."""
    code = F.col("activity_code")
    counts = (
        activities.filter(in_wells(F.col("well"), wells))
        .groupBy("well")
        .agg(
            F.count_if(code.startswith("interruption")).alias("interruptions"),
            F.count_if(mentions_severe()).alias("severe_mentions"),
            F.count_if(code.startswith("well_control")).alias("well_control"),
            F.count_if(mentions_fishing()).alias("fishing_mentions"),
            F.count("*").alias("total_activities"),
        )
    )
    # Both sides are one row per well by now.
    joined = counts.join(perforation_counts(perforations), "well", "left").fillna(
        {"perf_count": 0, "deepest_perf_md": 0.0}
    )
    score = (
        F.col("severe_mentions") * 3.0
        + F.col("well_control") * 5.0
        + F.col("fishing_mentions") * 2.0
        + F.col("interruptions") * 0.05
        + F.when(F.col("perf_count") > 0, 1.0).otherwise(0.0)
    )
    return joined.withColumn("risk_score", score)


def production_summary(production: DataFrame, wells=None) -> DataFrame:
    return (
        production.filter(in_wells(F.col("well"), wells))
        .groupBy("well")
        .agg(
            F.count("*").alias("prod_days"),
            F.sum("bore_oil_vol").alias("cum_oil"),
            F.sum("bore_gas_vol").alias("cum_gas"),
            F.sum("bore_wat_vol").alias("cum_water"),
            F.avg("avg_downhole_pressure").alias("avg_pressure"),
        )
    )


def field_benchmarks(
    tables,
    mode: str,
    wells: list[str] | None = None,
    hole_size_in: float | None = None,
    formation: str | None = None,
    top_n: int = 5,
) -> DataFrame:
    """Top and bottom rows of one of the five benchmarks."""

    def ranked(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
        order = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys]
        back = [F.asc_nulls_first(c) if down else F.desc_nulls_first(c) for c, down in keys]
        return top_bottom(df, order, back, top_n)

    if mode == "daily_progress":
        df = daily_progress(tables["ddr_status"], wells, hole_size_in)
        return ranked(df, [("avg_daily_m", True), ("well", False), ("hole_diameter_in", False)])
    if mode == "section_performance":
        df = section_performance(
            tables["witsml_mudlog"], tables["ddr_status"], wells, hole_size_in
        )
        tail = [("well", False), ("hole_diameter_in", False)]
        hardest = ranked(df, [("difficulty_index", True), *tail]).withColumn("board", F.lit("hardest"))
        fastest = ranked(df, [("avg_rop", True), *tail]).withColumn("board", F.lit("fastest"))
        return hardest.unionByName(fastest)
    if mode == "gas_response":
        df = gas_response(
            tables["witsml_mudlog"], tables["formation_tops"], formation or "Hugin", wells
        )
        return ranked(df, [("max_ch4", True), ("max_c2", True), ("well", False)])
    if mode == "risk":
        df = risk(tables["ddr_activities"], tables["perforations"], wells)
        return ranked(df, [("risk_score", True), ("well", False)])
    if mode == "production_summary":
        return ranked(
            production_summary(tables["production"], wells), [("cum_oil", True), ("well", False)]
        )
    raise ValueError(f"unknown benchmark mode {mode!r}")
