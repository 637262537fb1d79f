"""Fixed-width picks, perforation lists and production sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalize_well_name, strip
from ..functions.numbers import to_double
from ..schemas import TABLES

# Columns of the picks file, 1-based start and width.
PICK_COLUMNS = {
    "well": (3, 24), "surface_name": (28, 40), "md_m": (79, 9), "tvd_m": (88, 9), "tvdss_m": (97, 9), "twt_ms": (106, 9),
}

# Sheet headers that differ from the table columns.
PRODUCTION_RENAMES = {
    "dateprd": "date", "npd_well_bore_name": "well", "npd_well_bore_code": "npd_code", "avg_choke_size_p": "avg_choke_size",
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Latin-1 lines without trailing white space."""
    # The text reader hands the bytes on as they are; they are decoded here.
    raw = spark.read.text(path, lineSep="\n").select(
        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("value")
    )
    return raw.select(F.regexp_replace("value", r"\s+$", "").alias("line"))


def well_picks(lines: DataFrame) -> DataFrame:
    """Formation tops of fixed-width lines; comments, headers, rules and short lines are skipped.

    Each row names its own well, so the header lines carry no state.
    """
    line = F.col("line")

    def cut(name: str) -> Column:
        return F.substring(line, *PICK_COLUMNS[name])

    is_data = (
        ~line.startswith("#")
        & ~line.rlike(r"^Well\s+.+$")
        & ~F.ltrim(line).startswith("Well name")
        & ~F.ltrim(line).startswith("---")
        & (F.length(line) >= 78)
    )
    return (
        lines.filter(is_data)
        .select(
            normalize_well_name(cut("well")).alias("well"),
            strip(cut("surface_name")).alias("surface_name"),
            *[to_double(cut(c)).alias(c) for c in ("md_m", "tvd_m", "tvdss_m", "twt_ms")],
        )
        .filter((F.col("well") != "") & (F.col("surface_name") != "") & F.col("md_m").isNotNull())
    )


def perforations(lines: DataFrame) -> DataFrame:
    """Perforated intervals: a well name of 24 characters, then numbers; other tokens are skipped."""
    line = F.col("line")
    is_data = (
        ~line.startswith("#") & ~line.contains("Well name") & ~line.contains("---") & (F.length(line) > 40)
    )
    tokens = F.split(strip(F.substring(line, 25, 1_000_000)), r"\s+")
    numbers = F.filter(F.transform(tokens, to_double), lambda x: x.isNotNull())
    names = ("md_top_m", "md_base_m", "tvd_top_m", "tvd_base_m")
    return (
        lines.filter(is_data)
        .select(strip(F.substring(line, 1, 24)).alias("raw"), numbers.alias("n"))
        .filter((F.col("raw") != "") & (F.size("n") >= 2))
        .select(
            normalize_well_name(F.col("raw")).alias("well"),
            *[F.get("n", F.lit(i)).alias(c) for i, c in enumerate(names)],
        )
    )


def clean_header(name: str) -> str:
    cleaned = name.strip().lower().replace(" ", "_").replace("(", "").replace(")", "")
    return cleaned.replace("/", "_per_")


def production(sheet: DataFrame) -> DataFrame:
    """Daily production by column name: a missing column is NULL, an extra one is left out."""
    cleaned = [clean_header(c) for c in sheet.columns]
    renamed = sheet.toDF(*[PRODUCTION_RENAMES.get(c, c) for c in cleaned])
    out = []
    for field in TABLES["production"].fields:
        kind = field.dataType.simpleString()
        if field.name not in renamed.columns:
            value = F.lit(None).cast(kind)
        elif field.name == "well":
            value = normalize_well_name(F.col("well").cast("string"))
        elif field.name == "date":
            value = F.date_format(F.col("date").try_cast("timestamp"), "yyyy-MM-dd")
        else:
            value = F.col(field.name).try_cast(kind)
        out.append(value.alias(field.name))
    return renamed.select(*out)


def read_well_picks(spark: SparkSession, path: str) -> DataFrame:
    return well_picks(read_lines(spark, path))


def read_perforations(spark: SparkSession, path: str) -> DataFrame:
    return perforations(read_lines(spark, path))


def read_production(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A CSV or Parquet export of the daily sheet."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return production(reader.format(fmt).load(path))
