"""Queries that apply the column functions and predicates to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import activity as a
from ..functions import names, numbers, predicates, text
from .adapter import TABLES
from .benchmark_queries import QUALITY, QUALITY_TORQUE, SEVERE_SQL
from .depth_queries import CATEGORY, ISSUE_WHERE
from .registry import query, rounded

RAW_NAMES = """select o_orderkey, case o_orderkey % 6 when 0 then '  NO 15/9-F-' || cast(o_custkey % 26 as string) || ' T2 '
 when 1 then 'NO  15/9-19 BT2' when 2 then '15/9--F-' || cast(o_custkey % 26 as string) when 3 then '15_9_F_' || cast(o_custkey % 26 as string) || '_C'
 when 4 then 'AB' else 'NO 15/9-' || cast(o_custkey as string) || ' A B' end as raw_name from {orders}"""


def _from(t, sql: str):
    return t.spark.sql(sql, **{n: t.source(n) for n in TABLES if "{" + n + "}" in sql})


def _plain(sql: str) -> str:
    for n in TABLES:
        sql = sql.replace("{" + n + "}", n)
    return sql


NORMAL = "regexp_replace(regexp_replace(regexp_replace(trim(raw_name), '^NO\\s+', ''), '[/\\- ]', '_', 'g'), '_+', '_', 'g')"


@query(
    "n1_normalize_well_name",
    sql=f"with r as ({_plain(RAW_NAMES)}) select o_orderkey, {NORMAL} as well from r",
)
def normalize(t):
    return _from(t, RAW_NAMES).select("o_orderkey", names.normalize_well_name(F.col("raw_name")).alias("well"))


@query(
    "n2_display_well_name",
    sql=f"""with r as ({_plain(RAW_NAMES)}), n as (select o_orderkey, {NORMAL} as w from r), p as (select *, string_split(w, '_') as p from n)
select o_orderkey, case when len(p) < 3 then w when p[3] = 'F' then rtrim(p[1] || '/' || p[2] || '-F-' || coalesce(p[4], '') || ' ' || array_to_string(p[5:], ' '))
 else rtrim(p[1] || '/' || p[2] || '-' || p[3] || ' ' || array_to_string(p[4:], ' ')) end as shown from p""",
)
def display(t):
    well = names.normalize_well_name(F.col("raw_name"))
    return _from(t, RAW_NAMES).select("o_orderkey", names.display_well_name(well).alias("shown"))


@query(
    "n3_well_matches",
    ["ddr_status"],
    """select report_no, well, well like '15_9_F_1%' as by_pattern, well = '15_9_F_1' as by_name from ddr_status""",
)
def matches(t):
    well = F.col("well")
    return t["ddr_status"].select(
        "report_no",
        "well",
        names.well_matches(well, "15_9_F_1*").alias("by_pattern"),
        names.well_matches(well, "15_9_F_1").alias("by_name"),
    )


RAW_NUMBERS = """select l_orderkey, l_linenumber, l_partkey, l_extendedprice, case cast(floor(l_extendedprice * 100 + 0.5) as bigint) % 9 when 0 then '-999.99' when 1 then '-999.25' when 2 then '-9999'
 when 3 then 'n/a' when 4 then '' when 5 then ' ' || cast(l_quantity as string) || ' ' when 6 then '-990' when 7 then cast(null as string) else cast(l_extendedprice as string) end as raw from {lineitem}"""


@query(
    "n4_clean_float",
    sql=f"""with r as ({_plain(RAW_NUMBERS)}), v as (select *, try_cast(trim(raw) as double) as v from r)
select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 2) as l_extendedprice, case when v >= -990 then v end as ddr_value,
 case when v not in (-999.25, -9999) then v end as witsml_value, case when v is not null then cast(trunc(v) as int) end as int_value from v""",
)
def clean_float(t):
    raw = F.col("raw")
    return rounded(
        _from(t, RAW_NUMBERS).select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            F.round("l_extendedprice", 2).alias("l_extendedprice"),
            numbers.clean_float_ddr(raw).alias("ddr_value"),
            numbers.clean_float_witsml(raw).alias("witsml_value"),
            numbers.to_int(raw).alias("int_value"),
        ),
        6,
    )


@query(
    "n5_unit_convert",
    ["witsml_trajectory"],
    """select file_no, pos, k3, k4, round(k5, 2) as k5, round(incl_rad * 180 / pi(), 6) as inclination_deg, round(azi_rad * 180 / pi(), 6) as azimuth_deg,
 round(incl_rad * 180 / pi() * 30, 6) as dls_deg_per_30m, round(k5 * 3600, 4) as rop_m_per_hr, round(k5 * 0.001, 6) as kn, round(azi_rad * 60, 6) as rpm,
 case when azi_rad * 600 between 0 and 300 then round(azi_rad * 600, 6) end as rpm_kept from witsml_trajectory""",
)
def units(t):
    incl, azi, k5 = F.col("incl_rad"), F.col("azi_rad"), F.col("k5")
    out = t["witsml_trajectory"].select(
        "file_no", "pos", "k3", "k4",
        F.round(k5, 2).alias("k5"),
        F.round(numbers.scaled(incl, numbers.RAD_TO_DEG), 6).alias("inclination_deg"),
        F.round(numbers.scaled(azi, numbers.RAD_TO_DEG), 6).alias("azimuth_deg"),
        F.round(numbers.scaled(incl, numbers.DLS_RAD_M_TO_DEG_30M), 6).alias("dls_deg_per_30m"),
        F.round(numbers.scaled(k5, numbers.MPS_TO_MPH), 4).alias("rop_m_per_hr"),
        F.round(numbers.scaled(k5, numbers.N_TO_KN), 6).alias("kn"),
        F.round(numbers.scaled(azi, numbers.CPS_TO_RPM), 6).alias("rpm"),
        F.round(numbers.rpm_in_range(azi * 600.0), 6).alias("rpm_kept"),
    )
    return out


# Every known code, one unknown code per family, and odd ones, with the labels they must get.
EXPECTED = [
    ("drilling -- drill", "Drilling", "productive"), ("drilling -- trip", "Tripping", "trip"),
    ("drilling -- ream", "Reaming", "productive"), ("drilling -- coring", "Coring", "productive"),
    ("cementing -- cement", "Cementing", "productive"), ("cementing -- casing", "Casing", "productive"),
    ("cementing -- liner", "Casing", "other"), ("completion -- completion", "Completion", "productive"),
    ("completion -- gravel pack", "Completion", "other"), ("completion -- perforate", "Completion", "other"),
    ("completion -- stimulate", "Completion", "other"), ("logging -- log", "Logging", "productive"),
    ("logging -- wireline", "Logging", "other"), ("well_control -- kick", "Well Control", "npt"),
    ("well_control -- kill", "Well Control", "npt"), ("well_control -- shut-in", "Well Control", "npt"),
    ("equipment -- rig", "Equipment", "other"), ("equipment -- bha", "Equipment", "other"),
    ("equipment -- mud", "Mud Work", "other"), ("interruption -- repair", "NPT - Repair", "npt"),
    ("interruption -- waiting on weather", "NPT - Weather", "npt"), ("interruption -- other", "Other", "npt"),
    ("interruption -- waiting", "NPT - Waiting", "npt"), ("interruption -- wait", "NPT - Waiting", "npt"),
    ("interruption -- maintain", "NPT - Repair", "npt"), ("testing -- test", "Testing", "other"),
    ("testing -- dst", "Testing", "other"), ("conditioning -- circulate", "Circulating", "other"),
    ("conditioning -- displace", "Circulating", "other"), ("drilling -- other", "Drilling", "other"),
    ("cementing -- squeeze", "Cementing", "other"), ("completion -- round trip", "Completion", "trip"),
    ("logging -- core", "Logging", "other"), ("well_control -- flow", "Well Control", "other"),
    ("equipment -- crane", "Equipment", "other"), ("interruption -- fish", "NPT - Repair", "other"),
    ("testing -- leak off", "Testing", "other"), ("conditioning -- hole", "Circulating", "other"),
    ("moving -- skid", "Other", "other"), ("", "Unknown", "other"),
    ("  Drilling -- DRILL ", "Drilling", "productive"), ("TRIPPING out", "Other", "trip"),
]
N_CODES = len(EXPECTED)
WORDS = [
    "WOC after cement job", "Changed MWD probe", "Gyro survey", "Rig up for casing", "Circulated bottoms up",
    "Safety meeting", "Slip and cut", "Leak test", "Nothing to report", "Slip & cut drill line", "Lost returns while circulating, loss rate 4",
    "Stuck in hole", "Flow check ok", "Influx seen", "Shut in well", "Condition mud", "Pressure test BOP", "Fished out cone", "FIT performed",
]


def _case(key: str, values: list[str]) -> str:
    return f"case {key} " + " ".join("when {} then '{}'".format(n, v.replace("'", "''")) for n, v in enumerate(values)) + " end"


CODED = (
    "select event_id, " + _case(f"event_id % {N_CODES}", [c for c, _, _ in EXPECTED]) + " as activity_code, "
    + _case(f"event_id % {len(WORDS)}", WORDS) + " as comments, "
    + _case("event_id % 5", ["success", "mud loss", "equipment failure", "operation failed", ""])
    + " as state_detail from {events}"
)


@query(
    "n7_classify_phase",
    sql="select event_id, " + _case(f"event_id % {N_CODES}", [p for _, p, _ in EXPECTED]) + " as phase from events",
)
def phase(t):
    return _from(t, CODED).select("event_id", a.classify_phase(F.col("activity_code")).alias("phase"))


@query(
    "n9_classify_time",
    sql="select event_id, " + _case(f"event_id % {N_CODES}", [c for _, _, c in EXPECTED]) + " as time_class from events",
)
def time_class(t):
    return _from(t, CODED).select("event_id", a.classify_time(F.col("activity_code")).alias("time_class"))


NPT_WORDS = [
    "Waiting on Cement", "MWD/Tool Issue", "Survey Operations", "Rig Up/Down", "Circulating/Conditioning", "Crew/Safety/Meeting",
    "Slip & Cut Drill Line", "Pressure Testing", "Other NPT (unclassified)", "Crew/Safety/Meeting", "Circulating/Conditioning",
    "Other NPT (unclassified)", "Other NPT (unclassified)", "Other NPT (unclassified)", "Other NPT (unclassified)", "Circulating/Conditioning",
    "Pressure Testing", "Other NPT (unclassified)", "Pressure Testing",
]


@query(
    "n10_npt_cause",
    sql="select event_id, " + _case(f"event_id % {len(WORDS)}", NPT_WORDS) + " as cause from events",
)
def cause(t):
    return _from(t, CODED).select("event_id", a.npt_cause(F.lit("interruption -- other"), F.col("comments")).alias("cause"))


@query(
    "n11_issue_category",
    sql=f"with e as ({_plain(CODED)}) select event_id, {CATEGORY} as category from e",
)
def category(t):
    return _from(t, CODED).select(
        "event_id", a.issue_category(F.col("activity_code"), F.col("state_detail"), F.col("comments")).alias("category")
    )


@query(
    "n8_hole_section_name",
    sql="""with d as (select o_orderkey, case when o_orderkey % 11 = 0 then cast(null as double) else cast(o_orderkey % 320 as double) / 8 end as d from orders)
select o_orderkey, d, case when d is null then 'Unknown' when d > 34 and d < 38 then 'Conductor (36")' when d > 28 and d < 32 then 'Conductor (30")'
 when d > 24 and d < 28 then 'Surface (26")' when d > 15.5 and d < 19.5 then 'Intermediate (17.5")' when d >= 10.375 and d < 14.25 then 'Production (12.25")'
 when d > 6.5 and d < 10.5 then 'Reservoir (8.5")' else cast(d as varchar) || '" Section' end as section from d""",
)
def hole_section(t):
    sizes = _from(
        t,
        "select o_orderkey, case when o_orderkey % 11 = 0 then cast(null as double) else cast(o_orderkey % 320 as double) / 8 end as d from {orders}",
    )
    return sizes.withColumn("section", numbers.hole_section_name(F.col("d")))


@query(
    "n12_truncate_text",
    sql="select doc_id, substr(text, 1, 120) as t120, length(substr(text, 1, 200)) as n200 from documents",
)
def truncate(t):
    body = F.col("text")
    return t.source("documents").select(
        "doc_id",
        text.truncate_text(body, 120).alias("t120"),
        F.length(text.truncate_text(body, 200)).cast("long").alias("n200"),
    )


@query(
    "n13_interval_mid",
    ["witsml_mudlog"],
    "select k1, k2, k3, k4, round(rop_avg_m_per_hr, 6) as rop_avg_m_per_hr, (coalesce(md_top_m, 0) + coalesce(md_bottom_m, 0)) / 2 as md_mid from witsml_mudlog",
)
def mid(t):
    return rounded(
        t["witsml_mudlog"].select(
            "k1", "k2", "k3", "k4", "rop_avg_m_per_hr",
            numbers.interval_mid(F.col("md_top_m"), F.col("md_bottom_m")).alias("md_mid"),
        ),
        6,
    )


@query(
    "n14_zscore",
    ["production"],
    """, w as (select well, avg(bore_oil_vol) as v from production group by well), s as (select count(*) as n, avg(v) as m, stddev_pop(v) as sd from w)
select well, round(v, 6) as v, round(case when n < 2 or sd = 0 then 0 else (v - m) / sd end, 6) as z from w cross join s""",
)
def z(t):
    per_well = t["production"].groupBy("well").agg(F.avg("bore_oil_vol").alias("v"))
    stats = per_well.agg(
        F.struct(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("sd")).alias("s")
    ).scalar()
    out = per_well.withColumn("s", stats)
    return rounded(out.select("well", "v", numbers.zscore(F.col("v"), F.col("s.m"), F.col("s.sd"), F.col("s.n")).alias("z")))


# -------------------------------------------------------------- predicates


@query(
    "f1_in_dates",
    ["ddr_status"],
    "select report_no, well, date from ddr_status where date between '1996-03-01' and '1998-02-28'",
)
def in_dates(t):
    return t["ddr_status"].filter(predicates.in_dates(F.col("date"), "1996-03-01", "1998-02-28")).select("report_no", "well", "date")


@query(
    "f2_in_depths",
    ["ddr_activities"],
    "select event_id, well, round(depth_m, 6) as depth_m from ddr_activities where depth_m between 250 and 1500",
)
def in_depths(t):
    return rounded(
        t["ddr_activities"].filter(predicates.in_depths(F.col("depth_m"), 250, 1500)).select("event_id", "well", "depth_m"), 6
    )


@query(
    "f3_mudlog_quality_filter",
    ["witsml_mudlog"],
    f"""select well, lith_type, count(*) as n, count(*) filter (where {QUALITY_TORQUE}) as n_all, count(*) filter (where {QUALITY}) as n_without_torque
from witsml_mudlog group by well, lith_type""",
)
def quality(t):
    return t["witsml_mudlog"].groupBy("well", "lith_type").agg(
        F.count("*").alias("n"),
        F.count_if(predicates.mudlog_quality()).alias("n_all"),
        F.count_if(predicates.mudlog_quality(with_torque=False)).alias("n_without_torque"),
    )


@query(
    "f6_problem_summary_predicate",
    ["ddr_status"],
    "select report_no, well, summary_24hr from ddr_status where regexp_matches(summary_24hr, 'problem|issue|failure|stuck|loss|kick|repair|wait')",
)
def problem_summary(t):
    return t["ddr_status"].filter(predicates.is_problem_summary()).select("report_no", "well", "summary_24hr")


@query(
    "f7_bha_mention_predicate",
    ["ddr_activities"],
    "select event_id, well, comments from ddr_activities where regexp_matches(lower(comments), 'bha|bit|pick up|p/u|tripped out|pooh|new assembly')",
)
def bha_mention(t):
    return t["ddr_activities"].filter(predicates.mentions_bha()).select("event_id", "well", "comments")


@query(
    "f8_well_list_filter",
    ["ddr_status"],
    "select well, count(*) as n from ddr_status where well in ('15_9_F_1', '15_9_F_4', '15_9_F_25') group by well",
)
def well_list(t):
    wells = ["15_9_F_1", "15_9_F_4", "15_9_F_25"]
    return t["ddr_status"].filter(predicates.in_wells(F.col("well"), wells)).groupBy("well").agg(F.count("*").alias("n"))


@query(
    "f9_risk_mentions",
    ["ddr_activities"],
    f"select event_id, well, ({SEVERE_SQL}) as severe, lower(coalesce(comments, '')) like '%fish%' as fishing, coalesce({ISSUE_WHERE}, false) as issue from ddr_activities",
)
def risk_mentions(t):
    return t["ddr_activities"].select(
        "event_id",
        "well",
        predicates.mentions_severe().alias("severe"),
        predicates.mentions_fishing().alias("fishing"),
        predicates.is_issue().alias("issue"),
    )
