"""Wells side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .overview import activity_distribution, hole_sections


def well_metrics(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row of comparison metrics per well with reports."""
    dist = F.when(F.col("dist_drill_m") > 0, F.col("dist_drill_m"))
    status = (
        tables["ddr_status"]
        .groupBy("well")
        .agg(
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
            F.countDistinct("date").alias("num_reports"),
            F.min("md_m").alias("min_depth"),
            F.max("md_m").alias("max_depth"),
            F.coalesce(F.avg(dist), F.lit(0.0)).alias("avg_daily_drill"),
            F.coalesce(F.max(dist), F.lit(0.0)).alias("max_daily_drill"),
        )
    )
    acts = (
        tables["ddr_activities"]
        .groupBy("well")
        .agg(
            F.count_if(F.col("activity_code") != "").alias("total_activities"),
            F.count_if(F.col("state") == "problem").alias("problem_count"),
        )
    )
    prod = (
        tables["production"]
        .groupBy("well")
        .agg(
            F.sum("bore_oil_vol").alias("cum_oil"),
            F.sum("bore_gas_vol").alias("cum_gas"),
            F.sum("bore_wat_vol").alias("cum_water"),
            F.avg("avg_downhole_pressure").alias("avg_pressure"),
        )
        .filter(F.col("cum_oil").isNotNull())
    )
    return (
        status.join(acts, "well", "left")
        .join(prod, "well", "left")
        .fillna(0, ["total_activities", "problem_count"])
    )


METRICS = (
    "num_reports", "min_depth", "max_depth", "total_activities", "problem_count",
    "avg_daily_drill", "max_daily_drill", "cum_oil", "cum_gas", "cum_water", "avg_pressure",
)


def long_metrics(metrics: DataFrame) -> DataFrame:
    """(well, metric, value): one row per number."""
    return metrics.select(
        "well",
        F.inline(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])
        ),
    )


def pair_frame(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    listed = F.array(
        *[F.struct(F.lit(i).cast("long").alias("pair_no"), F.lit(a).alias("well_a"), F.lit(b).alias("well_b")) for i, (a, b) in enumerate(pairs)]
    )
    return spark.range(1).select(F.inline(listed))


def _side_by_side(values: DataFrame, pairs: DataFrame, item: str, cols: Sequence[str], default: Column | None) -> DataFrame:
    """Pivot per-well rows into columns of a pair: one join on the well, one aggregation."""
    sides = pairs.select(
        "pair_no",
        "well_a",
        "well_b",
        F.inline(
            F.array(
                F.struct(F.lit("a").alias("side"), F.col("well_a").alias("well")),
                F.struct(F.lit("b").alias("side"), F.col("well_b").alias("well")),
            )
        ),
    )
    joined = values.join(sides, "well")

    def cell(col: str, side: str) -> Column:
        value = F.max(F.when(F.col("side") == side, F.col(col)))
        return (value if default is None else F.coalesce(value, default)).alias(f"{col}_{side}")

    return joined.groupBy("pair_no", "well_a", "well_b", item).agg(
        *[cell(c, s) for c in cols for s in ("a", "b")]
    )


def compare_metrics(tables: Mapping[str, DataFrame], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Metrics of the wells of each pair; production counts as 0 only where the other well has some."""
    values = long_metrics(well_metrics(tables))
    pair_rows = pair_frame(values.sparkSession, pairs)
    return _side_by_side(values, pair_rows, "metric", ["value"], None).withColumnRenamed("metric", "item")


def compare_activities(tables: Mapping[str, DataFrame], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Counts and shares of every activity code either well of a pair has; missing is 0."""
    codes = activity_distribution(tables["ddr_activities"])
    pair_rows = pair_frame(codes.sparkSession, pairs)
    return _side_by_side(codes, pair_rows, "activity_code", ["cnt", "pct"], F.lit(0))


def compare_wells(tables: Mapping[str, DataFrame], well_a: str, well_b: str) -> dict[str, DataFrame]:
    pair = [(well_a, well_b)]
    return {
        "metrics": compare_metrics(tables, pair),
        "activities": compare_activities(tables, pair),
        "hole_sections": hole_sections(
            tables["ddr_status"].filter(F.col("well").isin(well_a, well_b))
        ),
    }
