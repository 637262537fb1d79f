"""Writing and loading the twelve tables and the document index."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import strip
from ..functions.numbers import iso_duration_hrs
from ..operators.overview import table_counts
from ..schemas import TABLES
from . import ddr, tabular, witsml


ORDERED_BY = ("date", "timestamp", "md_top_m", "md_start_m", "md_m")


def by_name(df: DataFrame, table: str) -> DataFrame:
    """Columns of the table in order and type; missing ones are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table].fields
        ]
    )


def write_tables(
    frames: Mapping[str, DataFrame], path: str, partition_by_well: tuple[str, ...] = ()
) -> None:
    """Full rebuild: every known table is overwritten, absent ones are written empty.

    Rows are dealt into ranges of well and then date, time or depth, and sorted, so that files hold few wells
    and short ranges: filters on them skip files.  Ranges are cut by sampled counts, so a large
    well is spread over many files.
    """
    spark = next(iter(frames.values())).sparkSession
    for table, schema in TABLES.items():
        df = by_name(frames[table], table) if table in frames else spark.createDataFrame([], schema)
        keys = [c for c in ("well", *ORDERED_BY) if c in df.columns][:2]
        writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
        if table in partition_by_well:
            writer = writer.partitionBy("well")
        writer.parquet(f"{path}/{table}")


def save_bucketed(frames: Mapping[str, DataFrame], buckets: int, prefix: str = "", by: tuple[str, ...] = ("well", "date")) -> None:
    """Save tables to the catalogue, bucketed and sorted by their keys.

    Tables of one number of buckets are joined, aggregated and anti-joined by these keys without an
    exchange.  A bucket is one task's work: choose as many as shuffles have partitions.
    """
    for name, df in frames.items():
        # Rows are dealt as buckets are, so that a bucket is one file.
        dealt = df.repartition(buckets, *by)
        dealt.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).format("parquet").saveAsTable(f"{prefix}{name}")


class BucketedTables(Mapping):
    """Saved tables by name, for the operators that take a mapping of tables."""

    def __init__(self, spark: SparkSession, names: list[str], prefix: str = ""):
        self.spark, self.names, self.prefix = spark, names, prefix

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        return self.spark.table(f"{self.prefix}{name}")

    def __iter__(self):
        return iter(self.names)

    def __len__(self):
        return len(self.names)


def footer_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Row counts from the footers of Parquet files: the count is pushed into the scan, no page is read.

    Only Spark's newer Parquet reader does so; it is asked for while these tables are opened.
    """
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    older = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(k for k in older.split(",") if k != "parquet"))
    try:
        frames = {name: spark.read.parquet(path) for name, path in paths.items()}
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", older)
    return table_counts(frames, list(paths))


def ingest(
    spark: SparkSession,
    out: str,
    ddr_dir: str | None = None,
    witsml_dir: str | None = None,
    picks_file: str | None = None,
    perforations_file: str | None = None,
    production_file: str | None = None,
    embed=None,
) -> DataFrame:
    """Read every given source, rebuild the tables and the document table, return row counts.

    The parsed reports are written first: all report tables then read them instead of the XML.
    """
    frames: dict[str, DataFrame] = {}
    if ddr_dir is not None:
        bronze = f"{out}/_ddr_reports"
        ddr.read_ddr_xml(spark, ddr_dir).write.mode("overwrite").parquet(bronze)
        reports = spark.read.parquet(bronze)
        ddr.parse_errors(reports).write.mode("overwrite").parquet(f"{out}/parse_errors")
        for name in ("ddr_status", "ddr_activities", "ddr_fluids", "ddr_surveys", "wellbore_info"):
            frames[name] = getattr(ddr, name)(reports)
    if picks_file is not None:
        frames["formation_tops"] = tabular.read_well_picks(spark, picks_file)
    if perforations_file is not None:
        frames["perforations"] = tabular.read_perforations(spark, perforations_file)
    if production_file is not None:
        frames["production"] = tabular.read_production(spark, production_file)
    if witsml_dir is not None:
        frames.update(witsml.read_witsml(spark, witsml_dir))
        witsml.rig_file_errors(spark, witsml_dir).write.mode("overwrite").parquet(f"{out}/rig_file_errors")
    write_tables(frames, out)
    tables = {name: spark.read.parquet(f"{out}/{name}") for name in TABLES}
    docs = ddr.ddr_text_docs(tables["ddr_status"], tables["ddr_activities"]).unionByName(
        ddr.message_text_docs(tables["witsml_messages"])
    )
    write_doc_index(docs, f"{out}/text_docs", embed)
    return table_counts(tables, list(TABLES))


def doc_index(docs: DataFrame, embed=None) -> DataFrame:
    """Documents with an id, depth 0 where missing, and an embedding if an embedder is supplied.

    The id is ``well_date_type_hash_ordinal``, where the hash is that of the whole row and equal rows are
    numbered: a rebuild or a repeated task gives the same ids.  Equal rows are counted, not gathered.
    """
    rows = docs.select(
        "well",
        "date",
        F.coalesce("depth_m", F.lit(0.0)).alias("depth_m"),
        "doc_type",
        F.coalesce("activity_code", F.lit("")).alias("activity_code"),
        "text",
    )
    digest = F.substring(F.sha2(F.to_json(F.struct(*rows.columns)), 256), 1, 24)
    name = F.concat_ws("_", "well", "date", "doc_type", digest, F.col("ordinal").cast("string"))
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    out = counted.withColumn("ordinal", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        name.alias("doc_id"), *rows.columns
    )
    return out if embed is None else out.withColumn("embedding", embed(F.col("text")))


def write_doc_index(docs: DataFrame, path: str, embed=None) -> None:
    doc_index(docs, embed).write.mode("overwrite").parquet(path)


def _row_id(df: DataFrame) -> DataFrame:
    """A tie-breaking number from the row's content, for tables that carry no unique id."""
    return F.xxhash64(*df.columns)


class Tables(Mapping):
    """The written tables under the names and with the helper columns the operators use.

    Ids break ties between rows of one day; typed times come from the ISO text.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getitem__(self, name: str) -> DataFrame:
        base = "ddr_activities" if name == "ddr_activities_timed" else name
        if base not in TABLES:
            raise KeyError(name)
        df = self.spark.read.schema(TABLES[base]).parquet(f"{self.path}/{base}")
        if base == "ddr_activities":
            return typed_activities(df)
        if base == "ddr_status":
            return df.withColumn("report_no", F.coalesce("report_no", F.lit(0)).cast("long"))
        extra = {"ddr_fluids": "sample_no", "formation_tops": "top_no", "witsml_bha_runs": "run_no", "witsml_messages": "message_no"}
        return df.withColumn(extra[base], _row_id(df)) if base in extra else df

    def __iter__(self):
        return iter([*TABLES, "ddr_activities_timed"])

    def __len__(self):
        return len(TABLES) + 1

    def register_views(self) -> None:
        """Temporary views under the table names, for ``spark.sql``."""
        for name in TABLES:
            self.spark.read.parquet(f"{self.path}/{name}").createOrReplaceTempView(name)


def typed_activities(activities: DataFrame) -> DataFrame:
    """Start and end as timestamps in UTC; the end is derived from the duration between the texts.

    So a pair of which only one has an offset counts as zero hours, as does a text that is no time.
    """
    start = F.when(strip(F.col("start_time")) != "", F.col("start_time").try_cast("timestamp"))
    hours = iso_duration_hrs(F.col("start_time"), F.col("end_time"))
    return activities.withColumn("event_id", _row_id(activities)).withColumns(
        {
            "start_ts": start,
            "end_ts": start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(hours * 3600, 6).cast("decimal(18,6)")),
        }
    )
