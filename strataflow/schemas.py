"""Column lists of the tables and of the XML inputs."""

from __future__ import annotations

from pyspark.sql import types as T

# The twelve tables, name and type of each column in order.
TABLE_COLUMNS = {
    "ddr_status": """well string, date string, report_no int, md_m double, tvd_m double, hole_diameter_in double,
        md_csg_last_m double, tvd_csg_last_m double, dist_drill_m double, water_depth_m double, elev_kelly_m double,
        rop_current_m_per_hr double, summary_24hr string, forecast_24hr string""",
    "ddr_activities": """well string, date string, start_time string, end_time string, depth_m double, phase string,
        activity_code string, state string, state_detail string, comments string""",
    "ddr_fluids": """well string, date string, mud_type string, mud_class string, location_sample string,
        density_gcc double, pv_mPas double, yp_Pa double, vis_funnel_s double""",
    "ddr_surveys": """well string, date string, md_m double, tvd_m double, inclination_deg double, azimuth_deg double""",
    "wellbore_info": """well string, date string, name_well string, name_wellbore string, spud_date string,
        drill_complete_date string, operator string, drill_contractor string, rig_name string""",
    "formation_tops": """well string, surface_name string, md_m double, tvd_m double, tvdss_m double, twt_ms double""",
    "perforations": """well string, md_top_m double, md_base_m double, tvd_top_m double, tvd_base_m double""",
    "production": """well string, date string, on_stream_hrs double, avg_downhole_pressure double,
        avg_downhole_temperature double, bore_oil_vol double, bore_gas_vol double, bore_wat_vol double, flow_kind string,
        avg_choke_size double, avg_whp_p double, avg_wht_p double""",
    "witsml_bha_runs": """well string, wellbore string, run_name string, start_time string, end_time string,
        num_bit_run string, num_string_run string, md_start_m double, md_stop_m double""",
    "witsml_mudlog": """well string, wellbore string, md_top_m double, md_bottom_m double, lith_type string,
        lith_pct double, rop_avg_m_per_hr double, rop_min_m_per_hr double, rop_max_m_per_hr double, wob_avg_kN double,
        torque_avg_kNm double, rpm_avg double, mud_weight_sg double, ecd_sg double, dxc double, methane_avg_ppm double,
        ethane_avg_ppm double""",
    "witsml_trajectory": """well string, wellbore string, timestamp string, md_m double, tvd_m double,
        inclination_deg double, azimuth_deg double, dls_deg_per_30m double, ns_m double, ew_m double""",
    "witsml_messages": """well string, wellbore string, timestamp string, md_m double, message_type string,
        message_text string""",
}

_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType()}


def columns(text: str) -> T.StructType:
    pairs = [column.split() for column in text.split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


TABLES = {name: columns(text) for name, text in TABLE_COLUMNS.items()}


def texts(*names: str) -> T.StructType:
    """A struct of text elements: numbers are cleaned later, by their own missing-value rules."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def struct(base: T.StructType, **nested: T.DataType) -> T.StructType:
    return T.StructType(base.fields + [T.StructField(n, kind) for n, kind in nested.items()])


# Elements are lists: where a document repeats one that should be single, the first counts.
DDR_REPORT = struct(
    texts("nameWell", "nameWellbore"),
    wellboreInfo=T.ArrayType(
        struct(
            texts("dTimSpud", "dateDrillComplete", "operator", "drillContractor"),
            rigAlias=T.ArrayType(texts("name")),
        )
    ),
    statusInfo=T.ArrayType(
        texts(
            "reportNo", "md", "tvd", "diaHole", "mdCsgLast", "tvdCsgLast", "distDrill", "waterDepth",
            "elevKelly", "ropCurrent", "sum24Hr", "forecast24Hr",
        )
    ),
    activity=T.ArrayType(
        texts("dTimStart", "dTimEnd", "md", "phase", "proprietaryCode", "state", "stateDetailActivity", "comments")
    ),
    fluid=T.ArrayType(
        texts("type", "mudClass", "locationSample", "density", "pv", "yp", "visFunnel")
    ),
    surveyStation=T.ArrayType(texts("md", "tvd", "incl", "azi")),
    porePressure=T.ArrayType(texts("md", "tvd", "ecd")),
)

WELLBORE = texts("nameWell", "name")
BHA_RUN = struct(
    texts("name", "dTimStart", "dTimStop", "numBitRun", "numStringRun"),
    drillingParams=T.ArrayType(texts("mdHoleStart", "mdHoleStop")),
)
GEOLOGY_INTERVAL = struct(
    texts(
        "mdTop", "mdBottom", "ropAv", "ropMn", "ropMx", "wobAv", "tqAv", "rpmAv", "wtMudAv", "ecdTdAv", "dxcAv"
    ),
    lithology=T.ArrayType(texts("type", "lithPc")),
    chromatograph=T.ArrayType(texts("methAv", "ethAv")),
)
TRAJECTORY_STATION = texts("dTimStn", "md", "tvd", "incl", "azi", "dls", "dispNs", "dispEw")
MESSAGE = texts("dTim", "md", "typeMessage", "messageText")
