"""Queries over the parsers: the input text is written by Spark from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import union_all
from ..operators.sizing import ensure_checkpoint_dir
from ..schemas import BHA_RUN, GEOLOGY_INTERVAL, MESSAGE, TABLES, TRAJECTORY_STATION, WELLBORE
from ..sources import ddr, tables, tabular, witsml
from .registry import query, rounded

# ------------------------------------------------------------ daily reports

KEY = "'15_9_F_' || cast(o_custkey % 26 as string)"
DAY = "cast(cast(o_orderdate as date) as string)"


def _uom(value: str, unit: str) -> str:
    """An element with a unit attribute."""
    return f"named_struct('_uom', '{unit}', '_VALUE', {value})"


def _activity(n: int) -> str:
    return f"""named_struct('dTimStart', d || 'T0{n}:00:00+01:00', 'dTimEnd', d || 'T0{n + 1}:30:00+01:00',
  'md', {_uom(f"cast(o_totalprice / 50 + {n} as string)", "m")}, 'phase', 'fixed', 'proprietaryCode', 'drilling -- {"drill" if n == 1 else "trip"}',
  'state', case when o_orderkey % 8 = 0 then 'problem' else 'ok' end, 'stateDetailActivity', 'success',
  'comments', case when o_orderkey % 4 = {n} then '  ' else ' Ran & pulled {n} at ' || o_orderpriority || ' ' end)"""


REPORTS = f"""
with o as (select *, {KEY} as w, {DAY} as d from {{orders}})
select o_orderkey, w, d, named_struct(
 'nameWell', 'NO ' || w, 'nameWellbore', 'NO ' || w || ' bore',
 'wellboreInfo', named_struct('dTimSpud', d || 'T00:00:00', 'operator', 'Operator ' || o_orderstatus, 'rigAlias', named_struct('name', 'RIG ' || cast(o_custkey % 3 as string))),
 'statusInfo', if(o_orderkey % 6 = 5, null, named_struct('reportNo', cast(o_orderkey as string) || case when o_orderkey % 7 = 0 then '.7' else '' end,
  'md', {_uom("case when o_orderkey % 11 = 0 then '-999.99' when o_orderkey % 13 = 0 then 'n/a' else cast(o_totalprice / 50 as string) end", "m")},
  'diaHole', {_uom("case when o_orderkey % 2 = 0 then '12.25' else ' 8.5 ' end", "in")},
  'ropCurrent', case when o_orderkey % 3 = 0 then '-999.99' when o_orderkey % 3 = 1 then '-999.25' else '25.5' end,
  'sum24Hr', case when o_orderkey % 9 = 0 then '' else '  Drilled <ahead> ' || o_orderpriority end,
  'forecast24Hr', case when o_orderkey % 5 = 0 then 'Run casing' else '' end)),
 'activity', if(o_orderkey % 3 = 0, null, array({_activity(1)}, {_activity(2)})),
 'fluid', if(o_orderkey % 2 = 1, null, named_struct('type', 'water based', 'mudClass', 'WBM', 'locationSample', 'flowline',
  'density', {_uom("cast(1 + cast(o_orderkey % 60 as double) / 100 as string)", "g/cm3")}, 'pv', cast(o_orderkey % 45 as string),
  'yp', case when o_orderkey % 10 = 0 then '-9999' else cast(o_orderkey % 17 as string) end)),
 'surveyStation', named_struct('md', cast(o_orderkey % 4000 as string), 'tvd', cast(o_orderkey % 3500 as string), 'incl', cast(o_orderkey % 90 as string), 'azi', cast(o_orderkey % 360 as string)),
 'porePressure', named_struct('md', cast(o_orderkey % 4000 as string), 'ecd', cast(1 + cast(o_orderkey % 30 as double) / 100 as string))
) as report from o"""


def _ddr_files(t) -> DataFrame:
    """One document per order: prefixed and default namespace, broken, empty and doubled ones."""
    key = F.col("o_orderkey")
    namespaces = " ".join(f'{a}="http://www.witsml.org/schemas/1series"' for a in ("xmlns", "xmlns:witsml"))
    body = F.col("body")
    inner = (
        F.when(key % 49 == 0, F.lit("<note/>"))
        .when(key % 47 == 0, F.concat(body, F.regexp_replace(body, "Drilled", "SECOND")))
        .otherwise(body)
    )
    prefixed = F.regexp_replace("plain", "<(/?)([A-Za-z])", "<$1witsml:$2")
    reports = t.spark.sql(REPORTS, orders=_spread(t.source("orders")))
    # One step per column: each is computed once and used by the next.
    return (
        reports.withColumn("body", F.to_xml("report", {"rowTag": "drillReport", "indent": ""}))
        .withColumn("inner", inner)
        .withColumn("plain", F.concat(F.lit(f"<drillReports {namespaces}>"), "inner", F.lit("</drillReports>")))
        .select(
            F.concat("w", F.lit("_"), F.translate("d", "-", "_"), F.lit(".xml")).alias("file"),
            F.when(key % 50 == 0, F.lit("<drillReports><drillReport></drillReports>"))
            .when(key % 2 == 0, prefixed)
            .otherwise(F.col("plain"))
            .alias("content"),
        )
    )


def _spread(df: DataFrame) -> DataFrame:
    """Input files come in many splits; the small test tables in one, so their rows are spread."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


# The same reports as rows: broken files and files without a report are left out.
GOOD = f"select *, {KEY} as well, {DAY} as date from orders where o_orderkey % 50 <> 0 and o_orderkey % 49 <> 0"
ACTS = """select g.*, n from good g, (values (1), (2)) v(n) where o_orderkey % 3 <> 0"""


def _reports(t) -> DataFrame:
    return ddr.parse_ddr(_ddr_files(t))


STATUS_SQL = """select well, date, cast(o_orderkey as int) as report_no,
 case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then null else round(o_totalprice / 50, 6) end as md_m, cast(null as double) as tvd_m,
 case when o_orderkey % 2 = 0 then cast(12.25 as double) else cast(8.5 as double) end as hole_diameter_in,
 cast(null as double) as md_csg_last_m, cast(null as double) as tvd_csg_last_m, cast(null as double) as dist_drill_m,
 cast(null as double) as water_depth_m, cast(null as double) as elev_kelly_m,
 case when o_orderkey % 3 = 2 then cast(25.5 as double) end as rop_current_m_per_hr,
 case when o_orderkey % 9 = 0 then '' else 'Drilled <ahead> ' || o_orderpriority end as summary_24hr,
 case when o_orderkey % 5 = 0 then 'Run casing' else '' end as forecast_24hr from good where o_orderkey % 6 <> 5"""
ACT_SQL = """select well, date, date || 'T0' || cast(n as varchar) || ':00:00+01:00' as start_time, date || 'T0' || cast(n + 1 as varchar) || ':30:00+01:00' as end_time,
 round(o_totalprice / 50 + n, 6) as depth_m, 'fixed' as phase, case when n = 1 then 'drilling -- drill' else 'drilling -- trip' end as activity_code,
 case when o_orderkey % 8 = 0 then 'problem' else 'ok' end as state, 'success' as state_detail,
 case when o_orderkey % 4 = n then '' else 'Ran & pulled ' || cast(n as varchar) || ' at ' || o_orderpriority end as comments from acts"""


@query(
    "s1_read_ddr_xml",
    sql=f"""select {KEY} as well, {DAY} as date, case when o_orderkey % 50 = 0 then 'XML parse error' when o_orderkey % 49 = 0 then 'No drillReport element' end as error,
 case when o_orderkey % 50 = 0 or o_orderkey % 49 = 0 or o_orderkey % 6 = 5 then 0 else 1 end as n_status,
 case when o_orderkey % 50 = 0 or o_orderkey % 49 = 0 or o_orderkey % 3 = 0 then 0 else 2 end as n_activities from orders""",
)
def read_ddr_xml(t):
    def size(element: str):
        return F.size(F.coalesce(f"report.{element}", F.array()))

    return _reports(t).select(
        "well", "date", "error", size("statusInfo").alias("n_status"), size("activity").alias("n_activities")
    )


@query("s2_ddr_key_from_filename", sql=f"select {KEY} as well, {DAY} as date from orders")
def key_from_filename(t):
    well, date = ddr.ddr_key_from_filename(F.col("file"))
    return _ddr_files(t).select(well.alias("well"), date.alias("date"))


@query("s3_ddr_status", sql=f"with good as ({GOOD}) {STATUS_SQL}")
def status(t):
    return rounded(ddr.ddr_status(_reports(t)), 6)


@query("s4_ddr_activities", sql=f"with good as ({GOOD}), acts as ({ACTS}) {ACT_SQL}")
def activities(t):
    return rounded(ddr.ddr_activities(_reports(t)), 6)


@query(
    "s5_ddr_fluids",
    sql=f"""with good as ({GOOD}) select well, date, 'water based' as mud_type, 'WBM' as mud_class, 'flowline' as location_sample,
 round(1 + cast(o_orderkey % 60 as double) / 100, 6) as density_gcc, cast(o_orderkey % 45 as double) as pv_mPas,
 case when o_orderkey % 10 = 0 then null else cast(o_orderkey % 17 as double) end as yp_Pa, cast(null as double) as vis_funnel_s from good where o_orderkey % 2 = 0""",
)
def fluids(t):
    return rounded(ddr.ddr_fluids(_reports(t)), 6)


@query(
    "s6_ddr_surveys",
    sql=f"""with good as ({GOOD}) select well, date, cast(o_orderkey % 4000 as double) as md_m, cast(o_orderkey % 3500 as double) as tvd_m,
 cast(o_orderkey % 90 as double) as inclination_deg, cast(o_orderkey % 360 as double) as azimuth_deg from good""",
)
def surveys(t):
    return ddr.ddr_surveys(_reports(t))


@query(
    "s7_ddr_pore_pressure",
    sql=f"""with good as ({GOOD}) select well, date, cast(o_orderkey % 4000 as double) as md_m, cast(null as double) as tvd_m,
 round(1 + cast(o_orderkey % 30 as double) / 100, 6) as emw_gcc from good""",
)
def pore_pressure(t):
    return rounded(ddr.ddr_pore_pressure(_reports(t)), 6)


@query(
    "s8_wellbore_info",
    sql=f"""with good as ({GOOD}) select well, date, 'NO ' || well as name_well, 'NO ' || well || ' bore' as name_wellbore, date || 'T00:00:00' as spud_date,
 '' as drill_complete_date, 'Operator ' || o_orderstatus as operator, '' as drill_contractor, 'RIG ' || cast(o_custkey % 3 as varchar) as rig_name from good""",
)
def wellbore(t):
    return ddr.wellbore_info(_reports(t))


@query(
    "s9_ddr_text_docs",
    sql=f"""with good as ({GOOD}), acts as ({ACTS}), s as ({STATUS_SQL}), a as ({ACT_SQL})
select well, date, md_m as depth_m, 'summary_24hr' as doc_type, '' as activity_code, summary_24hr as text from s where summary_24hr <> ''
union all select well, date, md_m, 'forecast_24hr', '', forecast_24hr from s where forecast_24hr <> ''
union all select well, date, depth_m, 'activity', activity_code, comments from a where comments <> ''""",
)
def text_docs(t):
    reports = ddr.parsed_once(_reports(t))
    return rounded(ddr.ddr_text_docs(ddr.ddr_status(reports), ddr.ddr_activities(reports)), 6)


@query(
    "s19_parse_errors",
    sql=f"""select {KEY} || '_' || replace({DAY}, '-', '_') || '.xml' as file,
 case when o_orderkey % 50 = 0 then 'XML parse error' else 'No drillReport element' end as error from orders where o_orderkey % 50 = 0 or o_orderkey % 49 = 0""",
)
def errors(t):
    return ddr.parse_errors(_reports(t))


# ---------------------------------------------------------------- rig data


def _elements(t, sql: str, schema: T.StructType, **sources: str) -> DataFrame:
    """Rows of ``sql`` with their ``xml`` text parsed into column ``e``."""
    rows = t.spark.sql(sql, **{k: _spread(t.source(v)) for k, v in sources.items()})
    parsed = rows.withColumn("x", F.from_xml("xml", schema.simpleString(), {"ignoreNamespace": "true"})).drop("xml")
    # Outer explode of one element: later filters cannot sink below the parser and run it twice.
    return parsed.select(*[c for c in parsed.columns if c != "x"], F.explode_outer(F.array("x")).alias("e"))


SECTION_FILES = """
select 'W' || cast(s_suppkey % 26 as string) as well_dir, cast(1 + s_suppkey % 3 as string) as section_dir, lpad(cast(s_suppkey as string), 9, '0') as file,
 '<wellbore><nameWell>' || case when s_suppkey % 26 = 7 then '' else 'NO 15/9-F-' || cast(s_suppkey % 26 as string) end || '</nameWell><name>' ||
 case when s_suppkey % 26 = 5 then ' ' else 'NO 15/9-F-' || cast(s_suppkey % 26 as string) || ' T' || cast(s_suppkey as string) end || '</name></wellbore>' as xml from {supplier}"""
SECTIONS_SQL = """
sections as (select well_dir, section_dir, case when w = 5 then '15_9_F_5' else '15_9_F_' || cast(w as varchar) || '_T' || cast(k as varchar) end as well,
  case when w = 5 then '' else 'NO 15/9-F-' || cast(w as varchar) || ' T' || cast(k as varchar) end as wellbore from (
  select 'W' || cast(s_suppkey % 26 as varchar) as well_dir, cast(1 + s_suppkey % 3 as varchar) as section_dir, s_suppkey % 26 as w, min(s_suppkey) as k
  from supplier where s_suppkey % 26 <> 7 group by 1, 2, 3))"""
IN_SECTION = "'W' || cast(l_suppkey % 26 as string) as well_dir, cast(1 + l_suppkey % 3 as string) as section_dir"


def _sections(t) -> DataFrame:
    return witsml.witsml_sections(_elements(t, SECTION_FILES, WELLBORE, supplier="supplier"))


@query("s10_witsml_sections", sql=f"with {SECTIONS_SQL} select * from sections")
def sections(t):
    return _sections(t)


@query(
    "s11_witsml_bha_runs",
    sql=f"""with {SECTIONS_SQL}, o as (select *, 'W' || cast(o_custkey % 26 as varchar) as well_dir, cast(1 + o_custkey % 3 as varchar) as section_dir from orders)
select well, wellbore, 'Run ' || cast(o_orderkey as varchar) as run_name, {DAY} || 'T00:00:00Z' as start_time, '' as end_time, cast(o_orderkey % 9 as varchar) as num_bit_run,
 '' as num_string_run, case when o_orderkey % 5 = 0 then null else cast(o_orderkey % 3500 as double) end as md_start_m,
 case when o_orderkey % 5 = 0 or o_orderkey % 4 = 0 then null else cast(o_orderkey % 3500 + 250 as double) end as md_stop_m
from o join sections using (well_dir, section_dir)""",
)
def bha_runs(t):
    text = f"""select 'W' || cast(o_custkey % 26 as string) as well_dir, cast(1 + o_custkey % 3 as string) as section_dir,
 '<bhaRun><name>Run ' || cast(o_orderkey as string) || '</name><dTimStart>' || {DAY} || 'T00:00:00Z</dTimStart><numBitRun>' || cast(o_orderkey % 9 as string) || '</numBitRun>' ||
 case when o_orderkey % 5 = 0 then '' else '<drillingParams><mdHoleStart uom="m">' || cast(o_orderkey % 3500 as string) || '</mdHoleStart><mdHoleStop>' ||
  case when o_orderkey % 4 = 0 then '-999.25' else cast(o_orderkey % 3500 + 250 as string) end || '</mdHoleStop></drillingParams>' end || '</bhaRun>' as xml from {{orders}}"""
    return witsml.bha_runs(witsml.with_section(_elements(t, text, BHA_RUN, orders="orders"), _sections(t)))


@query(
    "s12_witsml_mudlog",
    sql=f"""with {SECTIONS_SQL}, l as (select *, {IN_SECTION}, cast(floor(l_extendedprice * 100 + 0.5) as bigint) as k from lineitem)
select well, wellbore, cast(l_orderkey % 4000 as double) as md_top_m, l_orderkey % 4000 + l_quantity as md_bottom_m, 'first ' || l_returnflag as lith_type,
 l_quantity as lith_pct, round(l_extendedprice / 100000 * 3600, 6) as rop_avg_m_per_hr, cast(null as double) as rop_min_m_per_hr, case when k % 3 = 0 then round(cast(-999.99 as double) * 3600, 6) end as rop_max_m_per_hr,
 round(l_quantity * 1000 * 0.001, 6) as wob_avg_kN, round(l_discount * 0.001, 6) as torque_avg_kNm, case when l_linenumber > 5 then null else cast(l_linenumber * 60 as double) end as rpm_avg,
 round(cast(1200 as double) * 0.001, 6) as mud_weight_sg, cast(null as double) as ecd_sg, round(l_tax, 6) as dxc, case when k % 4 <> 0 then round(l_extendedprice, 6) end as methane_avg_ppm, cast(null as double) as ethane_avg_ppm
from l join sections using (well_dir, section_dir)""",
)
def mudlog(t):
    text = f"""with l as (select *, {IN_SECTION}, cast(floor(l_extendedprice * 100 + 0.5) as bigint) as k from {{lineitem}})
select well_dir, section_dir, '<w:geologyInterval xmlns:w="x"><w:mdTop uom="m">' || cast(l_orderkey % 4000 as string) || '</w:mdTop><w:mdBottom uom="m">' || cast(l_orderkey % 4000 + l_quantity as string) ||
 '</w:mdBottom><w:ropAv uom="m/s">' || cast(l_extendedprice / 100000 as string) || '</w:ropAv><w:ropMn>-999.25</w:ropMn>' || case when k % 3 = 0 then '<w:ropMx>-999.99</w:ropMx>' else '' end ||
 '<w:wobAv>' || cast(l_quantity * 1000 as string) || '</w:wobAv><w:tqAv>' || cast(l_discount as string) || '</w:tqAv><w:rpmAv uom="c/s">' || cast(l_linenumber as string) || '</w:rpmAv><w:wtMudAv>1200</w:wtMudAv><w:ecdTdAv>-9999</w:ecdTdAv><w:dxcAv>' ||
 cast(l_tax as string) || '</w:dxcAv><w:lithology><w:type>first ' || l_returnflag || '</w:type><w:lithPc>' || cast(l_quantity as string) || '</w:lithPc></w:lithology><w:lithology><w:type>second</w:type></w:lithology>' ||
 case when k % 4 = 0 then '' else '<w:chromatograph><w:methAv>' || cast(l_extendedprice as string) || '</w:methAv></w:chromatograph>' end || '</w:geologyInterval>' as xml from l"""
    rows = _elements(t, text, GEOLOGY_INTERVAL, lineitem="lineitem")
    return rounded(witsml.mudlog(witsml.with_section(rows, _sections(t))), 6)


@query(
    "s13_witsml_trajectory",
    sql=f"""with {SECTIONS_SQL}, l as (select *, {IN_SECTION} from lineitem where l_linenumber <> 6),
d as (select *, row_number() over (partition by well_dir, section_dir, l_orderkey % 500 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as r from l)
select well, wellbore, '' as timestamp, cast(l_orderkey % 500 as double) as md_m, cast(l_partkey as double) as tvd_m, round(l_tax * 10 * 180 / pi(), 6) as inclination_deg,
 round(l_discount * 10 * 180 / pi(), 6) as azimuth_deg, round(l_tax * 180 / pi() * 30, 6) as dls_deg_per_30m, cast(null as double) as ns_m, round(l_extendedprice, 6) as ew_m
from d join sections using (well_dir, section_dir) where r = 1""",
)
def trajectory(t):
    text = f"""select {IN_SECTION}, l_orderkey as file, l_linenumber as pos, l_partkey as k3, l_suppkey as k4, l_extendedprice as k5,
 '<trajectoryStation><md uom="m">' || case when l_linenumber = 6 then '-999.25' else cast(l_orderkey % 500 as string) end || '</md><tvd>' || cast(l_partkey as string) || '</tvd><incl uom="rad">' || cast(l_tax * 10 as string) ||
 '</incl><azi>' || cast(l_discount * 10 as string) || '</azi><dls>' || cast(l_tax as string) || '</dls><dispNs>-9999</dispNs><dispEw>' || cast(l_extendedprice as string) || '</dispEw></trajectoryStation>' as xml from {{lineitem}}"""
    rows = witsml.with_section(_elements(t, text, TRAJECTORY_STATION, lineitem="lineitem"), _sections(t))
    return rounded(witsml.trajectory(rows, order=["file", "pos", "k3", "k4", "k5"]), 6)


_CLEAN = "translate(translate(text, '<>&', '   '), chr(13), ' ')"


@query(
    "s14_witsml_messages",
    sql=f"""with {SECTIONS_SQL}, m as (select *, 'W' || cast(doc_id % 26 as varchar) as well_dir, cast(1 + doc_id % 3 as varchar) as section_dir from documents)
select well, wellbore, '2013-04-' || lpad(cast(1 + doc_id % 28 as varchar), 2, '0') || 'T06:00:00Z' as timestamp, cast(doc_id % 4000 as double) as md_m, source as message_type,
 md5(regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '^\\s+', ''), '\\s+$', '')) as text_md5 from m join sections using (well_dir, section_dir)""",
)
def messages(t):
    text = """select 'W' || cast(doc_id % 26 as string) as well_dir, cast(1 + doc_id % 3 as string) as section_dir,
 '<message><dTim>2013-04-' || lpad(cast(1 + doc_id % 28 as string), 2, '0') || 'T06:00:00Z</dTim><md>' || cast(doc_id % 4000 as string) || '</md><typeMessage>' || source || '</typeMessage><messageText>' ||
 regexp_replace(translate(translate(text, '<>&', '   '), chr(13), ' '), '[\\\\x00-\\\\x08\\\\x0B\\\\x0C\\\\x0E-\\\\x1F]', '') || '</messageText></message>' as xml from {documents}"""
    rows = witsml.messages(witsml.with_section(_elements(t, text, MESSAGE, documents="documents"), _sections(t)))
    return rows.withColumn("text_md5", F.md5("message_text")).drop("message_text")


@query(
    "s19_rig_file_errors",
    sql="""select 'W' || cast(doc_id % 26 as varchar) || '/1/message/' || cast(doc_id as varchar) || '.xml' as file,
 case when coalesce(text, '') = '' or doc_id % 11 = 0 then 'Empty file' when doc_id % 7 = 0 then 'XML parse error' else 'No message element' end as error
from documents where coalesce(text, '') = '' or doc_id % 11 = 0 or doc_id % 7 = 0 or doc_id % 5 = 0""",
)
def rig_file_errors(t):
    """Every document is a message file; some are empty, broken off, or hold no message."""
    files = t.spark.sql(
        """select 'W' || cast(doc_id % 26 as string) || '/1/message/' || cast(doc_id as string) || '.xml' as file,
 case when coalesce(text, '') = '' or doc_id % 11 = 0 then '' when doc_id % 7 = 0 then '<message><messageText>' || length(text)
  when doc_id % 5 = 0 then null else '<message><messageText>' || length(text) || '</messageText></message>' end as xml from {documents}""",
        documents=t.source("documents"),
    )
    schema = T.StructType([*MESSAGE.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = files.filter("xml <> ''").select("file", F.from_xml("xml", schema.simpleString(), {"mode": "PERMISSIVE"}).alias("e"))
    listed = files.select("file", F.coalesce(F.length("xml"), F.lit(1)).alias("length"), F.lit("message").alias("row_tag"))
    return witsml.rejected(listed, parsed.select("file", F.col("e._corrupt_record").isNotNull().alias("broken")))


# ------------------------------------------------------------ flat sources


@query(
    "s15_read_well_picks",
    sql="""select '15_9_F_' || cast(p_partkey % 26 as varchar) as well, 'Formation ' || cast(p_partkey % 40 as varchar) || ' Top' as surface_name, cast(p_partkey * 7 % 4000 as double) / 4 as md_m,
 case when p_partkey % 3 = 0 then null else cast(p_partkey % 3000 as double) end as tvd_m, -cast(p_partkey % 2900 as double) as tvdss_m, case when p_partkey % 4 = 0 then null else cast(p_partkey % 2000 as double) end as twt_ms
from part where p_partkey % 17 <> 0 and p_partkey % 19 <> 0 and p_partkey % 23 <> 0 and p_partkey % 29 <> 0""",
)
def well_picks(t):
    lines = t.spark.sql(
        """select case when p_partkey % 17 = 0 then '# comment line' when p_partkey % 19 = 0 then '  ' || repeat('-', 110) when p_partkey % 29 = 0 then 'Well NO 15/9-F-' || repeat('1', 90)
 else '  ' || rpad('NO 15/9-F-' || cast(p_partkey % 26 as string), 24, ' ') || ' ' || rpad('Formation ' || cast(p_partkey % 40 as string) || ' Top', 40, ' ') || repeat(' ', 11)
  || lpad(case when p_partkey % 23 = 0 then 'abc' else cast(cast(p_partkey * 7 % 4000 as double) / 4 as string) end, 9, ' ') || lpad(case when p_partkey % 3 = 0 then '' else cast(p_partkey % 3000 as string) end, 9, ' ')
  || lpad(cast(-(p_partkey % 2900) as string), 9, ' ') || case when p_partkey % 4 = 0 then '' else lpad(cast(p_partkey % 2000 as string), 9, ' ') end end as line from {part}""",
        part=t.source("part"),
    )
    return tabular.well_picks(lines)


@query(
    "s16_read_perforations",
    sql="""select '15_9_F_' || cast(s_suppkey % 13 as varchar) as well, cast(3000 + s_suppkey as double) as md_top_m, cast(3010 + s_suppkey as double) as md_base_m,
 case when s_suppkey % 3 = 0 then null else cast(2900 as double) end as tvd_top_m, case when s_suppkey % 3 = 1 then cast(2950.5 as double) end as tvd_base_m from supplier where s_suppkey % 7 <> 0""",
)
def perforations(t):
    lines = t.spark.sql(
        """select case when s_suppkey % 7 = 0 then rpad('15/9-F-1', 24, ' ') || ' 3000 open                      ' else rpad('15/9-F-' || cast(s_suppkey % 13 as string), 24, ' ')
 || '   ' || cast(3000 + s_suppkey as string) || ' open ' || cast(3010 + s_suppkey as string) || case when s_suppkey % 3 = 0 then '' when s_suppkey % 3 = 1 then ' 2900 x 2950.5' else ' 2900' end || ' last' end as line from {supplier}""",
        supplier=t.source("supplier"),
    )
    return tabular.perforations(lines)


@query(
    "s17_read_production",
    sql="""select '15_9_F_' || cast(o_custkey % 26 as varchar) as well, cast(cast(o_orderdate as date) as varchar) as date, cast(24 as double) as on_stream_hrs, cast(o_orderkey % 300 as double) as avg_downhole_pressure,
 cast(null as double) as avg_downhole_temperature, round(o_totalprice, 2) as bore_oil_vol, cast(null as double) as bore_gas_vol, case when o_orderstatus = 'P' then null else round(o_totalprice / 3, 6) end as bore_wat_vol, 'production' as flow_kind,
 cast(31.5 as double) as avg_choke_size, cast(null as double) as avg_whp_p, cast(null as double) as avg_wht_p from orders""",
)
def production(t):
    sheet = t.source("orders").select(
        F.col("o_orderdate").alias("DATEPRD"),
        F.concat(F.lit("NO 15/9-F-"), (F.col("o_custkey") % 26).cast("string")).alias("NPD_WELL_BORE_NAME"),
        F.lit("24").alias("ON STREAM (HRS)"),
        (F.col("o_orderkey") % 300).alias(" AVG_DOWNHOLE_PRESSURE "),
        F.col("o_totalprice").alias("Bore Oil Vol"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 3).alias("BORE_WAT_VOL"),
        F.lit("production").alias("FLOW_KIND"),
        F.lit(31.5).alias("AVG_CHOKE_SIZE_P"),
        F.lit("x").alias("npd/field"),
    )
    return rounded(tabular.production(sheet), 6)


@query(
    "s18_message_text_docs",
    ["witsml_messages"],
    """select well, '2013-04-22' as date, cast(message_no % 4000 as double) as depth_m, 'witsml_message' as doc_type, coalesce(message_type, '') as activity_code, md5(message_text) as text_md5
from witsml_messages where length(message_text) > 5""",
)
def message_docs(t):
    rows = t["witsml_messages"].select(
        "well", F.lit("2013-04-22T10:00:00Z").alias("timestamp"), (F.col("message_no") % 4000).cast("double").alias("md_m"), "message_type", "message_text"
    )
    return ddr.message_text_docs(rows).withColumn("text_md5", F.md5("text")).drop("text")


# ------------------------------------------------------------------- sinks


WRITTEN = tuple(TABLES)


@query(
    "k1_write_tables",
    list(WRITTEN),
    " union all ".join(f"select '{n}' as table_name, well, count(*) as row_count from {n} group by well" for n in WRITTEN),
)
def write_tables(t):
    """All twelve tables, written and read back."""
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
    tables.write_tables({n: t[n] for n in WRITTEN}, folder)
    counts = [
        t.spark.read.parquet(f"{folder}/{n}").groupBy("well").agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "well", "row_count")
        for n in WRITTEN
    ]
    return union_all(counts)


SOURCES = ["customer", "orders", "lineitem", "part", "supplier", "events", "documents", "conversations"]


@query("k2_footer_counts", sql=" union all ".join(f"select '{n}' as table_name, count(*) as row_count from {n}" for n in SOURCES))
def footer_counts(t):
    return tables.footer_counts(t.spark, {n: f"{t.sf_dir}/{n}.parquet" for n in SOURCES})


@query(
    "k1_bucketed_mud_days",
    ["ddr_fluids", "ddr_activities_aligned"],
    """, days as (select distinct well, date from ddr_activities_aligned where state = 'problem')
select f.well, d.well is not null as problem, count(*) as samples, count(distinct f.date) as n_days from ddr_fluids f left join days d on f.well = d.well and f.date = d.date group by 1, 2""",
)
def bucketed_mud_days(t):
    """Mud samples on days with problems and on others, over tables bucketed by well and date."""
    prefix = f"b{uuid.uuid4().hex[:8]}_"
    names = ["ddr_fluids", "ddr_activities"]
    tables.save_bucketed({"ddr_fluids": t["ddr_fluids"], "ddr_activities": t["ddr_activities_aligned"].filter("state = 'problem'").select("well", "date", "event_id")}, 16, prefix)
    saved = tables.BucketedTables(t.spark, names, prefix)
    days = saved["ddr_activities"].select("well", "date").distinct().withColumn("hit", F.lit(True))
    daily = saved["ddr_fluids"].groupBy("well", "date").agg(F.count("*").alias("n"))
    met = daily.join(days, ["well", "date"], "left")
    return met.groupBy("well", F.col("hit").isNotNull().alias("problem")).agg(F.sum("n").alias("samples"), F.count("*").alias("n_days"))


@query(
    "k3_write_doc_index",
    ["ddr_status", "ddr_activities", "witsml_messages"],
    """, d as (select well, date, md_m as depth_m, 'summary_24hr' as doc_type, '' as activity_code, summary_24hr as text from ddr_status where summary_24hr <> ''
 union all select well, date, depth_m, 'activity', activity_code, comments from ddr_activities where comments <> ''
 union all select well, '', null, 'witsml_message', coalesce(message_type, ''), message_text from witsml_messages where length(message_text) > 5)
select well, doc_type, count(*) as n_docs, count(*) as n_ids, round(sum(coalesce(depth_m, 0)), 2) as depth_sum, cast(sum(length(text)) as bigint) as chars from d group by well, doc_type""",
)
def doc_index(t):
    """Written and read back; ids must be unique, and the embedding holds the length of the text."""
    status = t["ddr_status"].withColumn("forecast_24hr", F.lit(""))
    messages = t["witsml_messages"].withColumns({"timestamp": F.lit(None).cast("string"), "md_m": F.lit(None).cast("double")})
    docs = ddr.ddr_text_docs(status, t["ddr_activities"]).unionByName(ddr.message_text_docs(messages))
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    tables.write_doc_index(docs, folder, embed=lambda text: F.array(F.length(text).cast("float"), F.lit(1.0).cast("float")))
    indexed = t.spark.read.parquet(folder)
    return rounded(
        indexed.groupBy("well", "doc_type").agg(
            F.count("*").alias("n_docs"),
            F.countDistinct("doc_id").alias("n_ids"),
            F.sum("depth_m").alias("depth_sum"),
            F.sum(F.element_at("embedding", 1)).cast("long").alias("chars"),
        ),
        2,
    )
