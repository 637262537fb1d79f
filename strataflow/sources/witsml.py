"""Rig data: ``{well}/{section}/{bhaRun,mudLog,trajectory,message}/*.xml``.

The readers split large files at element borders; the projections take frames with a section key
and one parsed element per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import normalize_well_name, strip
from ..functions.numbers import (
    CPS_TO_RPM,
    DLS_RAD_M_TO_DEG_30M,
    KGM3_TO_SG,
    MPS_TO_MPH,
    N_TO_KN,
    NM_TO_KNM,
    RAD_TO_DEG,
    clean_float_witsml,
    clean_floats_witsml,
    rpm_in_range,
    scaled,
)
from ..schemas import BHA_RUN, GEOLOGY_INTERVAL, MESSAGE, TRAJECTORY_STATION, WELLBORE

_SECTION = r"/([^/.][^/]*)/([^/]+)/(?:_wellboreInfo|bhaRun|mudLog|trajectory|message)/[^/]+$"


def _text(col: str) -> Column:
    return F.coalesce(strip(F.col(col)), F.lit(""))


def _float(col: str) -> Column:
    return clean_float_witsml(F.col(col))


def _with_floats(rows: DataFrame, *fields: str) -> DataFrame:
    """The rows with the numbers in these fields, under the fields' own names."""
    read = rows.withColumn("_numbers", clean_floats_witsml([F.col(field) for field in fields]))
    return read.withColumns({field.split(".")[-1]: F.get("_numbers", F.lit(i)) for i, field in enumerate(fields)}).drop("_numbers")


# Each folder of a section, the element it holds and what an element is parsed into.
FOLDERS = {
    "_wellboreInfo": ("wellbore", WELLBORE),
    "bhaRun": ("bhaRun", BHA_RUN),
    "mudLog": ("geologyInterval", GEOLOGY_INTERVAL),
    "trajectory": ("trajectory", T.StructType([T.StructField("trajectoryStation", T.ArrayType(TRAJECTORY_STATION))])),
    "message": ("message", MESSAGE),
}


def of_sections(files: DataFrame) -> DataFrame:
    """Rows of files below section folders that count, with the names of well and section."""
    return files.withColumns(
        {"well_dir": F.regexp_extract("file", _SECTION, 1), "section_dir": F.regexp_extract("file", _SECTION, 2)}
    ).filter(in_section(F.col("well_dir"), F.col("section_dir")))


def parsed_elements(spark: SparkSession, path: str, folder: str, stream: dict | None = None) -> DataFrame:
    """``file, e, _corrupt_record`` per element of one kind of folder; ``stream`` holds options of a file stream."""
    row_tag, schema = FOLDERS[folder]
    reader = spark.read if stream is None else spark.readStream.options(**stream)
    return (
        reader.format("xml")
        .option("rowTag", row_tag)
        .option("ignoreNamespace", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.xml")
        .schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())]))
        .load(f"{path.rstrip('/')}/*/*/{folder}")
        .select(
            "_corrupt_record",
            F.col("_metadata.file_path").alias("file"),
            F.struct(*schema.fieldNames()).alias("e"),
        )
    )


def read_elements(spark: SparkSession, path: str, folder: str, stream: dict | None = None) -> DataFrame:
    """Elements below every section folder of one kind, as column ``e`` with section and file.

    A malformed file gives rows that carry its text in ``_corrupt_record``; they are dropped here and named by
    ``rig_file_errors``.
    """
    rows = parsed_elements(spark, path, folder, stream)
    return of_sections(rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record"))


def rejected(listed: DataFrame, parsed: DataFrame) -> DataFrame:
    """``file, error`` of listed files (``file, length, row_tag``) without a readable element or with a broken one.

    ``parsed`` has a row per element: ``file`` and whether it is ``broken``.
    """
    seen = parsed.groupBy("file").agg(F.count_if("broken").alias("broken"), F.count_if(~F.col("broken")).alias("good"))
    reason = (
        F.when(F.col("length") == 0, "Empty file")
        .when(F.col("broken") > 0, "XML parse error")
        .when(F.col("good").isNull(), F.concat(F.lit("No "), "row_tag", F.lit(" element")))
    )
    return listed.join(seen, "file", "left").select("file", reason.alias("error")).filter(F.col("error").isNotNull())


def rig_file_errors(spark: SparkSession, path: str) -> DataFrame:
    """``file, error`` of every rig file that gave nothing or broke off, of all five folders.

    Files are listed, not read again: what the parser made of them is joined to the listing.  The listing is
    the one the driver has for every scan; scans leave out empty files, which are told apart by that.
    """

    def errors(folder: str) -> DataFrame:
        scan = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(f"{path.rstrip('/')}/*/*/{folder}")
        # Local names have three slashes there and one in the rows.
        names = spark.createDataFrame([(name.replace("file:///", "file:/"),) for name in scan.inputFiles()], "file string")
        lengths = scan.select(F.col("_metadata.file_path").alias("file"), "length")
        files = names.join(lengths, "file", "left").na.fill(0, ["length"]).withColumn("row_tag", F.lit(FOLDERS[folder][0]))
        # The reader refuses to look at broken records alone, so a field is read beside them.
        field = F.col("e").getField(FOLDERS[folder][1].fieldNames()[0]).cast("string")
        broken = F.col("_corrupt_record").isNotNull() & (F.char_length(F.coalesce(field, F.lit(""))) >= 0)
        rows = parsed_elements(spark, path, folder).select("file", broken.alias("broken"))
        return rejected(of_sections(files).drop(*SECTION_KEY), rows)

    return reduce(DataFrame.unionByName, [errors(folder) for folder in FOLDERS])


def in_section(well_dir: Column, section_dir: Column) -> Column:
    """Folders that count: not hidden, and a section of letters, digits and blanks only."""
    return (well_dir != "") & ~well_dir.startswith(".") & F.url_decode(section_dir).rlike(r"^(?=.*[A-Za-z0-9])[A-Za-z0-9 ]+$")


SECTION_KEY = ["well_dir", "section_dir"]


def witsml_sections(wellbores: DataFrame) -> DataFrame:
    """Well and wellbore of each section from its first readable file; unnamed wells drop out.

    The wellbore name is the key, because reports use it; without one the well name is.
    """
    first = wellbores.groupBy(*SECTION_KEY).agg(
        F.min_by(
            F.struct(_text("e.nameWell").alias("name_well"), _text("e.name").alias("wellbore")), F.col("file")
        ).alias("s")
    )
    named = first.filter(F.col("s.name_well") != "")
    bore, well = normalize_well_name(F.col("s.wellbore")), normalize_well_name(F.col("s.name_well"))
    return named.select(
        *SECTION_KEY, F.when(bore != "", bore).otherwise(well).alias("well"), F.col("s.wellbore").alias("wellbore")
    )


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    return witsml_sections(read_elements(spark, path, "_wellboreInfo"))


def with_section(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """Elements with their section's well; sections without a name give nothing.

    Pass ``sized`` sections: one row per folder, measured once for all kinds of elements.
    """
    return elements.join(sections, SECTION_KEY)


def bha_runs(rows: DataFrame) -> DataFrame:
    params = F.get("e.drillingParams", F.lit(0))
    return rows.withColumn("p", params).select(
        "well",
        "wellbore",
        _text("e.name").alias("run_name"),
        _text("e.dTimStart").alias("start_time"),
        _text("e.dTimStop").alias("end_time"),
        _text("e.numBitRun").alias("num_bit_run"),
        _text("e.numStringRun").alias("num_string_run"),
        _float("p.mdHoleStart").alias("md_start_m"),
        _float("p.mdHoleStop").alias("md_stop_m"),
    )


def mudlog(rows: DataFrame) -> DataFrame:
    """Geology intervals in field units; the first lithology stands for the interval."""
    rows = rows.withColumns(
        {"lith": F.get("e.lithology", F.lit(0)), "gas": F.get("e.chromatograph", F.lit(0))}
    )
    rows = _with_floats(
        rows,
        *[f"e.{name}" for name in ("mdTop", "mdBottom", "ropAv", "ropMn", "ropMx", "wobAv", "tqAv", "rpmAv", "wtMudAv", "ecdTdAv", "dxcAv")],
        *["lith.lithPc", "gas.methAv", "gas.ethAv"],
    )
    return rows.select(
        "well",
        "wellbore",
        F.col("mdTop").alias("md_top_m"),
        F.col("mdBottom").alias("md_bottom_m"),
        _text("lith.type").alias("lith_type"),
        F.col("lithPc").alias("lith_pct"),
        scaled(F.col("ropAv"), MPS_TO_MPH).alias("rop_avg_m_per_hr"),
        scaled(F.col("ropMn"), MPS_TO_MPH).alias("rop_min_m_per_hr"),
        scaled(F.col("ropMx"), MPS_TO_MPH).alias("rop_max_m_per_hr"),
        scaled(F.col("wobAv"), N_TO_KN).alias("wob_avg_kN"),
        scaled(F.col("tqAv"), NM_TO_KNM).alias("torque_avg_kNm"),
        rpm_in_range(scaled(F.col("rpmAv"), CPS_TO_RPM)).alias("rpm_avg"),
        scaled(F.col("wtMudAv"), KGM3_TO_SG).alias("mud_weight_sg"),
        scaled(F.col("ecdTdAv"), KGM3_TO_SG).alias("ecd_sg"),
        F.col("dxcAv").alias("dxc"),
        F.col("methAv").alias("methane_avg_ppm"),
        F.col("ethAv").alias("ethane_avg_ppm"),
    )


def stations_of(rows: DataFrame, section: list[str], order: list[str]) -> DataFrame:
    """Survey stations in degrees, with their section and place; those without a depth drop out."""
    return rows.select(
        *section,
        *order,
        "well",
        "wellbore",
        _text("e.dTimStn").alias("timestamp"),
        _float("e.md").alias("md_m"),
        _float("e.tvd").alias("tvd_m"),
        scaled(_float("e.incl"), RAD_TO_DEG).alias("inclination_deg"),
        scaled(_float("e.azi"), RAD_TO_DEG).alias("azimuth_deg"),
        scaled(_float("e.dls"), DLS_RAD_M_TO_DEG_30M).alias("dls_deg_per_30m"),
        _float("e.dispNs").alias("ns_m"),
        _float("e.dispEw").alias("ew_m"),
    ).filter(F.col("md_m").isNotNull())


def trajectory(rows: DataFrame, section: list[str] = SECTION_KEY, order: list[str] = ["file", "pos"]) -> DataFrame:
    """Survey stations; the first station of each depth in a section counts.

    ``min_by`` keeps one row per depth in the map tasks already, so repeated stations do not pile up.
    """
    return first_station(stations_of(rows, section, order), section, order).drop(*section)


def first_station(stations: DataFrame, section: list[str], order: list[str]) -> DataFrame:
    """First row per (section, depth) in file and document order."""
    kept = [c for c in stations.columns if c not in (*section, *order, "md_m")]
    return (
        stations.groupBy(*section, "md_m")
        .agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("s"))
        .select(*section, "md_m", "s.*")
    )


def messages(rows: DataFrame) -> DataFrame:
    return rows.select(
        "well",
        "wellbore",
        _text("e.dTim").alias("timestamp"),
        _float("e.md").alias("md_m"),
        _text("e.typeMessage").alias("message_type"),
        _text("e.messageText").alias("message_text"),
    )


def read_stations(spark: SparkSession, path: str, stream: dict | None = None) -> DataFrame:
    """Stations with their place in the file: trajectories are read whole to keep document order."""
    return read_elements(spark, path, "trajectory", stream).select(
        *SECTION_KEY, "file", F.posexplode("e.trajectoryStation").alias("pos", "e")
    )


def read_witsml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All four tables below a rig-data folder."""
    sections = read_sections(spark, path)

    def rows(folder: str) -> DataFrame:
        return with_section(read_elements(spark, path, folder), sections)

    return {
        "witsml_bha_runs": bha_runs(rows("bhaRun")),
        "witsml_mudlog": mudlog(rows("mudLog")),
        "witsml_trajectory": trajectory(with_section(read_stations(spark, path), sections)),
        "witsml_messages": messages(rows("message")),
    }
