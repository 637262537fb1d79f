"""Daily drilling reports: one XML file per well and day.

``read_ddr_files`` gives file rows, ``parse_ddr`` one nested row per report; the tables are projections.
The projections take any frame of that shape, also a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import strip
from ..functions.numbers import clean_float_ddr, to_int
from ..operators.ordered import union_all
from ..schemas import DDR_REPORT

_DOCUMENT = T.StructType(
    [
        T.StructField("drillReport", T.ArrayType(DDR_REPORT)),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_ddr_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of each report file; a file is one day of one well, so a row is small."""
    return (
        spark.read.option("pathGlobFilter", "*.xml")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
    )


def ddr_key_from_filename(file: Column) -> tuple[Column, Column]:
    """``<well>_YYYY_MM_DD.xml`` -> (well, ISO date)."""
    pattern = r"^(?:.*/)?(.*)_([^_/]+)_([^_/]+)_([^_/.]+)\.xml$"
    day = F.concat_ws("-", *[F.regexp_extract(file, pattern, n) for n in (2, 3, 4)])
    return F.regexp_extract(file, pattern, 1), day


def parse_ddr(files: DataFrame) -> DataFrame:
    """One row per file: key, first report of the file, and the reason when there is none.

    Both prefixed and default-namespace documents are read.
    """
    well, date = ddr_key_from_filename(F.col("file"))
    document = F.from_xml(
        "content",
        _DOCUMENT.simpleString(),
        {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    report = F.get("doc.drillReport", F.lit(0))
    return (
        files.withColumn("doc", document)
        .select(
            "file",
            well.alias("well"),
            date.alias("date"),
            report.alias("report"),
            F.when(F.col("doc._corrupt_record").isNotNull(), "XML parse error")
            .when(report.isNull(), "No drillReport element")
            .alias("error"),
        )
    )


def parsed_once(reports: DataFrame) -> DataFrame:
    """Reports behind an exchange that all tables made from them share, so that each document is parsed once.

    The slice, which holds the report as it is, has every table ask for the whole of it; else each had an exchange
    of its own part.
    """
    dealt = reports.repartition("file")
    whole = F.explode_outer(F.slice(F.array("report"), 1, 1)).alias("report")
    return dealt.select(*[whole if c == "report" else c for c in reports.columns])


def read_ddr_xml(spark: SparkSession, path: str) -> DataFrame:
    return parse_ddr(read_ddr_files(spark, path))


def parse_errors(reports: DataFrame) -> DataFrame:
    # Outer explode for the reason given at ``_elements``.
    reasons = reports.select("file", F.explode_outer(F.array("error")).alias("error"))
    return reasons.filter(F.col("error").isNotNull())


def _text(col: str) -> Column:
    return F.coalesce(strip(F.col(col)), F.lit(""))


def _float(col: str) -> Column:
    return clean_float_ddr(F.col(col))


def _elements(reports: DataFrame, items: Column) -> DataFrame:
    """One row per element.  An outer explode keeps Spark from adding a filter on the array, which
    it would push below the parser and so parse every document twice."""
    return reports.select("well", "date", "report", F.explode_outer(items).alias("e")).filter(
        F.col("e").isNotNull()
    )


def _first(reports: DataFrame, element: str) -> DataFrame:
    return _elements(reports, F.slice(f"report.{element}", 1, 1))


def ddr_status(reports: DataFrame) -> DataFrame:
    info = "e"
    return _first(reports, "statusInfo").select(
        "well",
        "date",
        to_int(F.col(f"{info}.reportNo")).alias("report_no"),
        _float(f"{info}.md").alias("md_m"),
        _float(f"{info}.tvd").alias("tvd_m"),
        _float(f"{info}.diaHole").alias("hole_diameter_in"),
        _float(f"{info}.mdCsgLast").alias("md_csg_last_m"),
        _float(f"{info}.tvdCsgLast").alias("tvd_csg_last_m"),
        _float(f"{info}.distDrill").alias("dist_drill_m"),
        _float(f"{info}.waterDepth").alias("water_depth_m"),
        _float(f"{info}.elevKelly").alias("elev_kelly_m"),
        _float(f"{info}.ropCurrent").alias("rop_current_m_per_hr"),
        _text(f"{info}.sum24Hr").alias("summary_24hr"),
        _text(f"{info}.forecast24Hr").alias("forecast_24hr"),
    )


def _repeated(reports: DataFrame, element: str) -> DataFrame:
    return _elements(reports, F.col(f"report.{element}"))


def ddr_activities(reports: DataFrame) -> DataFrame:
    return _repeated(reports, "activity").select(
        "well",
        "date",
        _text("e.dTimStart").alias("start_time"),
        _text("e.dTimEnd").alias("end_time"),
        _float("e.md").alias("depth_m"),
        _text("e.phase").alias("phase"),
        _text("e.proprietaryCode").alias("activity_code"),
        _text("e.state").alias("state"),
        _text("e.stateDetailActivity").alias("state_detail"),
        _text("e.comments").alias("comments"),
    )


def ddr_fluids(reports: DataFrame) -> DataFrame:
    return _repeated(reports, "fluid").select(
        "well",
        "date",
        _text("e.type").alias("mud_type"),
        _text("e.mudClass").alias("mud_class"),
        _text("e.locationSample").alias("location_sample"),
        _float("e.density").alias("density_gcc"),
        _float("e.pv").alias("pv_mPas"),
        _float("e.yp").alias("yp_Pa"),
        _float("e.visFunnel").alias("vis_funnel_s"),
    )


def ddr_surveys(reports: DataFrame) -> DataFrame:
    return _repeated(reports, "surveyStation").select(
        "well",
        "date",
        _float("e.md").alias("md_m"),
        _float("e.tvd").alias("tvd_m"),
        _float("e.incl").alias("inclination_deg"),
        _float("e.azi").alias("azimuth_deg"),
    )


def ddr_pore_pressure(reports: DataFrame) -> DataFrame:
    return _repeated(reports, "porePressure").select(
        "well",
        "date",
        _float("e.md").alias("md_m"),
        _float("e.tvd").alias("tvd_m"),
        _float("e.ecd").alias("emw_gcc"),
    )


def wellbore_info(reports: DataFrame) -> DataFrame:
    info = "e"
    return _first(reports, "wellboreInfo").withColumn("rig", F.get("e.rigAlias", F.lit(0))).select(
        "well",
        "date",
        _text("report.nameWell").alias("name_well"),
        _text("report.nameWellbore").alias("name_wellbore"),
        _text(f"{info}.dTimSpud").alias("spud_date"),
        _text(f"{info}.dateDrillComplete").alias("drill_complete_date"),
        _text(f"{info}.operator").alias("operator"),
        _text(f"{info}.drillContractor").alias("drill_contractor"),
        _text("rig.name").alias("rig_name"),
    )


def ddr_text_docs(status: DataFrame, activities: DataFrame) -> DataFrame:
    """Summary, forecast and each activity comment as documents; empty texts give none."""

    def docs(rows: DataFrame, depth: str, code: Column, **kinds: str) -> DataFrame:
        texts = F.array(*[F.struct(F.lit(kind).alias("doc_type"), F.col(text).alias("text")) for kind, text in kinds.items()])
        found = rows.select("well", "date", F.col(depth).alias("depth_m"), code.alias("activity_code"), F.inline(texts))
        return found.filter(F.coalesce("text", F.lit("")) != "").select("well", "date", "depth_m", "doc_type", "activity_code", "text")

    return union_all(
        [
            docs(status, "md_m", F.lit(""), summary_24hr="summary_24hr", forecast_24hr="forecast_24hr"),
            docs(activities, "depth_m", F.coalesce("activity_code", F.lit("")), activity="comments"),
        ]
    )


def message_text_docs(messages: DataFrame) -> DataFrame:
    """Messages longer than five characters as documents dated by their timestamp."""
    return messages.filter(F.length("message_text") > 5).select(
        "well",
        F.coalesce(F.substring("timestamp", 1, 10), F.lit("")).alias("date"),
        F.col("md_m").alias("depth_m"),
        F.lit("witsml_message").alias("doc_type"),
        F.coalesce("message_type", F.lit("")).alias("activity_code"),
        F.col("message_text").alias("text"),
    )
