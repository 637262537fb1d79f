"""New report files as a stream, through the same parser and projections as the batch reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import ddr, tables


def stream_ddr(spark: SparkSession, path: str, max_files: int = 10_000) -> DataFrame:
    """Parsed reports of the files that arrive under ``path``."""
    files = (
        spark.readStream.option("pathGlobFilter", "*.xml")
        .option("maxFilesPerTrigger", max_files)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
    )
    return ddr.parse_ddr(files)


def append_table(reports: DataFrame, table: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append one report table (``ddr_status``, ``ddr_activities``, ...) and stop when no file is left."""
    rows = tables.by_name(getattr(ddr, table)(reports), table)
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(f"{out}/{table}")
    )
