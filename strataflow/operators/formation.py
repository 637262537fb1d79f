"""Formation context of a depth, with the parent well's tops where a well has none."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import parent_well
from .intervals import asof_neighbors


def tops_or_parent(wells: DataFrame, tops: DataFrame) -> DataFrame:
    """Tops of each wanted well: its own, else those of its parent (first four name parts)."""
    with_tops = tops.select("well").distinct().withColumn("has_own", F.lit(True))
    source = (
        wells.select("well")
        .distinct()
        .join(with_tops, "well", "left")
        .withColumn("source_well", F.when(F.col("has_own"), F.col("well")).otherwise(parent_well(F.col("well"))))
        .select("well", "source_well")
    )
    return source.join(tops.withColumnRenamed("well", "source_well"), "source_well")


def formation_context(tables: Mapping[str, DataFrame], probes: DataFrame) -> DataFrame:
    """Current, previous and next formation of each (well, depth_m) row."""
    tops = tops_or_parent(probes, tables["formation_tops"])
    return asof_neighbors(probes, tops, ["well"], "depth_m", "surface_name", "md_m", "top_no")
