"""New rig files as streams, through the same parser and projections as the batch reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import tables, witsml

APPENDED = {
    "witsml_bha_runs": ("bhaRun", witsml.bha_runs),
    "witsml_mudlog": ("mudLog", witsml.mudlog),
    "witsml_messages": ("message", witsml.messages),
}


def stream_rig(spark: SparkSession, path: str, table: str, sections: DataFrame, max_files: int = 10_000) -> DataFrame:
    """Rows of assemblies, mud log or messages from the files that arrive under ``path``.

    ``sections`` is a table (see ``witsml.read_sections``); a file of a section it lacks gives nothing.
    """
    folder, project = APPENDED[table]
    elements = witsml.read_elements(spark, path, folder, stream={"maxFilesPerTrigger": str(max_files)})
    return tables.by_name(project(witsml.with_section(elements, sections)), table)


def append_rig_table(rows: DataFrame, table: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the rows to a table and stop when no file is left."""
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(f"{out}/{table}")
    )


def stream_stations(spark: SparkSession, path: str, sections: DataFrame, max_files: int = 10_000) -> DataFrame:
    """The first station of each depth of a section so far, kept as state under that key.

    A station of an earlier file that arrives later takes the place of the one before: rows are updates.
    """
    elements = witsml.read_stations(spark, path, stream={"maxFilesPerTrigger": str(max_files)})
    placed = witsml.stations_of(witsml.with_section(elements, sections), witsml.SECTION_KEY, ["file", "pos"])
    return witsml.first_station(placed, witsml.SECTION_KEY, ["file", "pos"])


def update_stations(stations: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's updates to a folder of its own; a batch that is run again overwrites its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/witsml_trajectory_updates/batch={number}")

    return (
        stations.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def latest_stations(spark: SparkSession, out: str) -> DataFrame:
    """The trajectory table: the last update of each key."""
    updates = spark.read.parquet(f"{out}/witsml_trajectory_updates")
    key = [*witsml.SECTION_KEY, "md_m"]
    fields = [c for c in updates.columns if c not in (*key, "batch")]
    last = updates.groupBy(*key).agg(F.max_by(F.struct(*fields), "batch").alias("s"))
    return tables.by_name(last.select("md_m", "s.*"), "witsml_trajectory")
