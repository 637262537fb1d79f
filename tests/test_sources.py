"""Readers on hand-made files, and a whole ingest."""

import math

import pytest
from pyspark.sql import functions as F

from strataflow.functions import numbers
from strataflow.operators import benchmarks, bha, compare, efficiency, formation, issues, narrative, overview, phases, search
from strataflow.sources import ddr, tables, tabular, witsml
from strataflow.streaming.reports import append_table, stream_ddr

NS = "http://www.witsml.org/schemas/1series"
BODY = """<@drillReports xmlns@="{ns}" version="1.4.0.0"><@drillReport>
<@nameWell>NO 15/9-F-11</@nameWell><@nameWellbore>NO 15/9-F-11 T2</@nameWellbore>
<@wellboreInfo><@dTimSpud>2013-03-07T00:00:00+01:00</@dTimSpud><@operator>Operator</@operator>
<@rigAlias><@name>RIG A</@name></@rigAlias><@rigAlias><@name>RIG B</@name></@rigAlias></@wellboreInfo>
<@statusInfo><@reportNo>{no}</@reportNo><@md uom="m">{md}</@md><@diaHole uom="in">26</@diaHole>
<@distDrill uom="m">{dist}</@distDrill><@ropCurrent>-999.99</@ropCurrent>
<@sum24Hr> Drilled &amp; circulated </@sum24Hr><@forecast24Hr/></@statusInfo>
<@fluid><@type>Water based</@type><@density uom="g/cm3">1.35</@density><@pv>-999.25</@pv></@fluid>
<@surveyStation><@md>300</@md><@tvd>299.5</@tvd><@incl>1.5</@incl><@azi>-999.99</@azi></@surveyStation>
<@porePressure><@md>300</@md><@ecd>1.2</@ecd></@porePressure>
{acts}</@drillReport>{more}</@drillReports>"""
ACTS = """<@activity><@dTimStart>2013-03-24T00:00:00+01:00</@dTimStart><@dTimEnd>2013-03-24T06:00:00+01:00</@dTimEnd>
<@md>250</@md><@proprietaryCode>drilling -- drill</@proprietaryCode><@state>ok</@state><@comments>Drilled 26" hole from 220 m</@comments></@activity>
<@activity><@dTimStart>2013-03-24T06:00:00+01:00</@dTimStart><@dTimEnd>2013-03-24T08:00:00</@dTimEnd><@proprietaryCode>interruption -- repair</@proprietaryCode>
<@state>problem</@state><@stateDetailActivity>equipment failure</@stateDetailActivity><@comments>   </@comments></@activity>"""


def report(no="1", md="306", dist="50", acts=ACTS, more="", prefix=True):
    xml = BODY.format(ns=NS, no=no, md=md, dist=dist, acts=acts, more=more)
    xml = xml.replace("xmlns@", "xmlns:witsml" if prefix else "xmlns")
    return xml.replace("@", "witsml:" if prefix else "")


@pytest.fixture(scope="module")
def ddr_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("ddr")
    files = {
        "15_9_F_11_T2_2013_03_24.xml": report(),
        "15_9_F_11_B_2013_03_24.xml": report(prefix=False),
        "15_9_F_1_2013_03_25.xml": report(no="3.7", md="deep", acts=""),
        "15_9_F_2_2013_03_25.xml": report(more="<@drillReport><@nameWell>second</@nameWell></@drillReport>"),
        "15_9_F_3_2013_03_25.xml": "<drillReports><drillReport></drillReports>",
        "15_9_F_4_2013_03_25.xml": f'<drillReports xmlns="{NS}"><other/></drillReports>',
        "notes.txt": "no report",
    }
    for name, text in files.items():
        (folder / name).write_text(text)
    return str(folder)


@pytest.fixture(scope="module")
def reports(spark, ddr_dir):
    return ddr.read_ddr_xml(spark, ddr_dir).cache()


def rows(df, well):
    return [r.asDict() for r in df.filter(F.col("well") == well).collect()]


def test_report_errors(reports):
    assert {r.file: r.error for r in ddr.parse_errors(reports).collect()} == {
        "15_9_F_3_2013_03_25.xml": "XML parse error",
        "15_9_F_4_2013_03_25.xml": "No drillReport element",
    }


def test_report_status(reports):
    status = ddr.ddr_status(reports)
    assert status.count() == 4
    first = rows(status, "15_9_F_11_T2")[0]
    assert (first["date"], first["report_no"], first["md_m"], first["hole_diameter_in"]) == ("2013-03-24", 1, 306.0, 26.0)
    assert first["rop_current_m_per_hr"] is None and first["tvd_m"] is None
    assert first["summary_24hr"] == "Drilled & circulated" and first["forecast_24hr"] == ""
    assert rows(status, "15_9_F_11_B")[0] == first | {"well": "15_9_F_11_B"}
    other = rows(status, "15_9_F_1")[0]
    assert (other["report_no"], other["md_m"]) == (3, None)


def test_report_children(reports):
    acts = rows(ddr.ddr_activities(reports), "15_9_F_11_T2")
    assert [a["activity_code"] for a in acts] == ["drilling -- drill", "interruption -- repair"]
    assert [a["depth_m"] for a in acts] == [250.0, None] and acts[1]["comments"] == ""
    assert rows(ddr.ddr_activities(reports), "15_9_F_1") == []
    fluid = rows(ddr.ddr_fluids(reports), "15_9_F_2")[0]
    assert fluid["density_gcc"] == 1.35 and fluid["pv_mPas"] is None and fluid["mud_class"] == ""
    survey = rows(ddr.ddr_surveys(reports), "15_9_F_2")[0]
    assert survey["inclination_deg"] == 1.5 and survey["azimuth_deg"] is None
    assert rows(ddr.ddr_pore_pressure(reports), "15_9_F_2")[0]["emw_gcc"] == 1.2
    info = rows(ddr.wellbore_info(reports), "15_9_F_2")[0]
    assert info["rig_name"] == "RIG A" and info["name_well"] == "NO 15/9-F-11"


def test_text_docs(reports):
    docs = ddr.ddr_text_docs(ddr.ddr_status(reports), ddr.ddr_activities(reports))
    kinds = sorted(r.doc_type for r in docs.filter("well = '15_9_F_11_T2'").collect())
    assert kinds == ["activity", "summary_24hr"]


def _w(tag, inner):
    return f'<{tag} xmlns="{NS}">{inner}</{tag}>'


@pytest.fixture(scope="module")
def witsml_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("witsml")

    def put(path, text):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)

    put("Well A/1/_wellboreInfo/a.xml", "<broken")
    put("Well A/1/_wellboreInfo/b.xml", _w("wellbores", "<wellbore><nameWell>NO 15/9-F-11</nameWell><name>NO 15/9-F-11 T2</name></wellbore>"))
    put("Well A/2/_wellboreInfo/b.xml", _w("wellbores", "<wellbore><nameWell>NO 15/9-F-12</nameWell></wellbore>"))
    put("Well A/3/_wellboreInfo/b.xml", _w("wellbores", "<wellbore><name>x</name></wellbore>"))
    put("Well A/3/message/m.xml", _w("messages", "<message><messageText>lost section</messageText></message>"))
    put("Well A/_log/_wellboreInfo/b.xml", _w("wellbores", "<wellbore><nameWell>hidden</nameWell></wellbore>"))
    put(
        "Well A/1/bhaRun/r.xml",
        _w("bhaRuns", "<bhaRun><name>Run 1</name><dTimStart>2013-04-01T00:00:00Z</dTimStart><numBitRun>1</numBitRun>"
           "<drillingParams><mdHoleStart uom='m'>100</mdHoleStart><mdHoleStop uom='m'>-999.25</mdHoleStop></drillingParams></bhaRun>"
           "<bhaRun><name>Run 2</name></bhaRun>"),
    )
    put("Well A/1/mudLog/bad.xml", "<mudLogs><mudLog><geologyInterval><mdTop>1")
    put(
        "Well A/1/mudLog/l.xml",
        _w("mudLogs", "<mudLog><geologyInterval><mdTop uom='m'>250</mdTop><mdBottom uom='m'>260</mdBottom><ropAv uom='m/s'>0.01</ropAv><ropMn>-999.99</ropMn>"
           "<wobAv>50000</wobAv><tqAv>9000</tqAv><rpmAv uom='c/s'>6</rpmAv><wtMudAv>1350</wtMudAv><ecdTdAv>-9999</ecdTdAv>"
           "<lithology><type>claystone</type><lithPc>80</lithPc></lithology><lithology><type>sandstone</type></lithology>"
           "<chromatograph><methAv>120</methAv></chromatograph></geologyInterval>"
           "<geologyInterval><mdTop>260</mdTop><mdBottom>270</mdBottom><rpmAv>2</rpmAv></geologyInterval></mudLog>"),
    )
    station = "<trajectoryStation><md>{md}</md><incl>{i}</incl><dispEw>{e}</dispEw></trajectoryStation>"
    put("Well A/1/trajectory/t1.xml", _w("trajectorys", "<trajectory>" + station.format(md=100, i=0.5, e=1) + station.format(md=200, i=0.6, e=2) + station.format(md=100, i=9, e=3) + "</trajectory>"))
    put("Well A/1/trajectory/t2.xml", _w("trajectorys", "<trajectory>" + station.format(md=200, i=9, e=4) + station.format(md=-999.25, i=1, e=5) + station.format(md=300, i=0.7, e=6) + "</trajectory>"))
    put("Well A/2/message/m.xml", _w("messages", "<message><dTim>2013-04-22T06:00:00Z</dTim><md>-999.25</md><typeMessage>event</typeMessage><messageText> Flow check, stable well </messageText></message>"))
    return str(root)


def test_witsml(spark, witsml_dir):
    out = witsml.read_witsml(spark, witsml_dir)
    runs = sorted(out["witsml_bha_runs"].collect(), key=lambda r: r.run_name)
    assert [(r.well, r.run_name, r.md_start_m, r.md_stop_m) for r in runs] == [
        ("15_9_F_11_T2", "Run 1", 100.0, None), ("15_9_F_11_T2", "Run 2", None, None),
    ]
    logs = sorted(out["witsml_mudlog"].collect(), key=lambda r: r.md_top_m)
    assert len(logs) == 2
    top = logs[0]
    assert (top.lith_type, top.lith_pct, top.methane_avg_ppm, top.ethane_avg_ppm) == ("claystone", 80.0, 120.0, None)
    assert top.rop_avg_m_per_hr == pytest.approx(36.0) and top.rop_min_m_per_hr == pytest.approx(-999.99 * 3600)
    assert top.wob_avg_kN == pytest.approx(50.0) and top.torque_avg_kNm == pytest.approx(9.0)
    assert top.rpm_avg is None and top.mud_weight_sg == pytest.approx(1.35) and top.ecd_sg is None
    assert logs[1].rpm_avg == pytest.approx(120.0) and logs[1].lith_type == ""
    stations = sorted(out["witsml_trajectory"].collect(), key=lambda r: r.md_m)
    assert [(s.md_m, s.ew_m) for s in stations] == [(100.0, 1.0), (200.0, 2.0), (300.0, 6.0)]
    assert stations[0].inclination_deg == pytest.approx(math.degrees(0.5))
    messages = out["witsml_messages"].collect()
    assert [(m.well, m.md_m, m.message_type, m.message_text) for m in messages] == [("15_9_F_12", None, "event", "Flow check, stable well")]


@pytest.fixture(scope="module")
def flat_files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("flat")

    def pick(well, surface, md, tvd="", tvdss="", twt=""):
        return ("  " + well.ljust(24) + " " + surface.ljust(40) + " " * 11 + md.rjust(9) + tvd.rjust(9) + tvdss.rjust(9) + twt.rjust(9)).rstrip()

    lines = [
        "# Well picks", "Well NO 15/9-F-11", "  Well name                Surface name", "  " + "-" * 100,
        pick("NO 15/9-F-11", "Nordland GP. Top", "100.5", "100.0", "-45.5", "300.25"),
        pick("NO 15/9-F-11", "Hugin Fm. Top", "2800.0", "", "-2700.0"),
        pick("NO 15/9-F-11", "Smørbukk Top", "bad"), pick("NO 15/9-F-11", "", "10"), "short line",
        pick("NO 15/9-F-11", "Søgne Top", "900"),
    ]
    (folder / "picks.dat").write_bytes(("\r\n".join(lines) + "\n").encode("latin-1"))
    perfs = ["# list", "Well name                MD top   MD base", "-" * 50] + [
        "NO 15/9-F-11            " + tail
        for tail in ("  3000.5  3010.25           ." + "x", "   3020    3030    2900           .", "   3040 open 3050    2900    2950 m", "   3060            only one       .")
    ] + ["15/9-F-1 short 1 2"]
    (folder / "perf.dat").write_text("\n".join(perfs))
    (folder / "prod.csv").write_text(
        "DATEPRD,WELL_BORE_CODE,NPD_WELL_BORE_NAME,ON_STREAM_HRS,AVG_CHOKE_SIZE_P,BORE_OIL_VOL,Bore Wat Vol,FLOW KIND,Some (x/y)\n"
        "2008-02-12,c,15/9-F-12,24,30.5,100.25,7,production,1\n2008-02-13,c,15/9-F-12,,,n/a,8,production,1\n"
    )
    return folder


def test_flat_sources(spark, flat_files):
    tops = sorted(tabular.read_well_picks(spark, str(flat_files / "picks.dat")).collect(), key=lambda r: r.md_m)
    assert [(t.well, t.surface_name, t.md_m, t.tvd_m, t.tvdss_m, t.twt_ms) for t in tops] == [
        ("15_9_F_11", "Nordland GP. Top", 100.5, 100.0, -45.5, 300.25), ("15_9_F_11", "Søgne Top", 900.0, None, None, None),
        ("15_9_F_11", "Hugin Fm. Top", 2800.0, None, -2700.0, None),
    ]
    perfs = sorted(tabular.read_perforations(spark, str(flat_files / "perf.dat")).collect())
    assert [tuple(p) for p in perfs] == [
        ("15_9_F_11", 3000.5, 3010.25, None, None), ("15_9_F_11", 3020.0, 3030.0, 2900.0, None), ("15_9_F_11", 3040.0, 3050.0, 2900.0, 2950.0),
    ]
    prod = sorted(tabular.read_production(spark, str(flat_files / "prod.csv")).collect(), key=lambda r: r.date)
    assert (prod[0].well, prod[0].date, prod[0].on_stream_hrs, prod[0].bore_oil_vol, prod[0].bore_wat_vol, prod[0].avg_choke_size) == (
        "15_9_F_12", "2008-02-12", 24.0, 100.25, 7.0, 30.5,
    )
    assert prod[1].bore_oil_vol is None and prod[0].flow_kind == "production" and prod[0].bore_gas_vol is None


def test_ingest_and_operators(spark, ddr_dir, witsml_dir, flat_files, tmp_path):
    out = str(tmp_path / "tables")
    counts = tables.ingest(
        spark, out, ddr_dir, witsml_dir, str(flat_files / "picks.dat"), str(flat_files / "perf.dat"), str(flat_files / "prod.csv"),
        embed=lambda text: F.array(F.length(text).cast("float"), F.lit(1.0).cast("float")),
    )
    assert {r.table_name: r.row_count for r in counts.collect()} == {
        "ddr_status": 4, "ddr_activities": 6, "ddr_fluids": 4, "ddr_surveys": 4, "wellbore_info": 4, "formation_tops": 3,
        "perforations": 3, "production": 2, "witsml_bha_runs": 2, "witsml_mudlog": 2, "witsml_trajectory": 3, "witsml_messages": 1,
    }
    docs = spark.read.parquet(f"{out}/text_docs")
    assert docs.select("doc_id").distinct().count() == docs.count() == 4 + 3 + 1
    t = tables.Tables(spark, out)
    t.register_views()
    assert spark.sql("select count(*) from ddr_status").first()[0] == 4
    hours = {r.well: r for r in efficiency.time_breakdown(efficiency.timed_activities(t["ddr_activities_timed"])).collect()}
    # The second activity mixes a time with an offset and one without: it counts zero hours.
    assert (hours["15_9_F_11_T2"].productive_hrs, hours["15_9_F_11_T2"].npt_hrs, hours["15_9_F_11_T2"].problem_count) == (6.0, 0.0, 1)
    parts = [
        overview.well_overview(t), efficiency.efficiency_metrics(t, "2013-01-01", "2013-12-31"), phases.drilling_phases(t),
        issues.operational_issues(t), compare.compare_wells(t, "15_9_F_11_T2", "15_9_F_2"),
        bha.bha_configurations(t),
    ]
    for part in parts:
        for frame in part.values():
            frame.collect()
    for mode in ("daily_progress", "section_performance", "gas_response", "risk", "production_summary"):
        benchmarks.field_benchmarks(t, mode).collect()
    with pytest.raises(ValueError):
        benchmarks.field_benchmarks(t, "speed")
    told = narrative.ddr_narrative(t, messages=t["witsml_messages"]).collect()
    assert {r.kind for r in told} == {"summary", "activity"}
    probes = spark.createDataFrame([("15_9_F_11_T2", 950.0)], "well string, depth_m double")
    context = formation.formation_context(t, probes).first()
    assert (context.current_name, context.above_name, context.below_name) == ("Søgne Top", "Nordland GP. Top", "Hugin Fm. Top")
    found = search.search_with_fallback(docs, "Drilled", embed=lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float")), k=3)
    assert found.count() == 3
    assert overview.table_schema(t, "perforations").count() == 5
    assert overview.run_sql(t, "select well from {ddr_status};", cap=2).count() == 2
    with pytest.raises(ValueError):
        overview.run_sql(t, "  ")
    assert overview.run_sql(t, "select well from ddr_status").count() == 4
    one = "15_9_F_11*"
    for parts in (
        overview.well_overview(t, one), efficiency.efficiency_metrics(t, well=one), phases.drilling_phases(t, well=one),
        issues.operational_issues(t, well=one), bha.bha_configurations(t, one), {"told": narrative.ddr_narrative(t, well=one)},
    ):
        for frame in parts.values():
            if "well" in frame.columns:
                assert all(r.well.startswith("15_9_F_11") for r in frame.select("well").distinct().collect())
    everything = narrative.ddr_narrative(t, n_summaries=None, n_activities=None, chars=None)
    assert everything.count() == 4 + 3 - t["ddr_status"].filter("summary_24hr is null").count() - t["ddr_activities"].filter("length(comments) < 20 and comments <> ''").count()


def test_report_stream(spark, ddr_dir, tmp_path):
    query = append_table(stream_ddr(spark, ddr_dir), "ddr_status", str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/ddr_status")).count() == 4


def test_trend_needs_six_issues(spark):
    rows = [("a", f"2013-01-{d:02d}") for d in range(1, 8)] + [("b", "2013-01-01")] * 5
    trend = issues.issue_trend(spark.createDataFrame(rows, "well string, date string")).collect()
    assert [(r.well, r.first_half, r.second_half, r.first_to, r.second_from, r.trend) for r in trend] == [
        ("a", 3, 4, "2013-01-03", "2013-01-04", "INCREASING")
    ]


def test_text_docs_parse_each_report_once(spark, ddr_dir):
    files = spark.createDataFrame([(r.file, r.content) for r in ddr.read_ddr_files(spark, ddr_dir).collect()], "file string, content string")
    reports = ddr.parse_ddr(files)
    shared = ddr.parsed_once(reports)
    out = ddr.ddr_text_docs(ddr.ddr_status(shared), ddr.ddr_activities(shared))
    rows = sorted(map(str, out.collect()))
    assert rows == sorted(map(str, ddr.ddr_text_docs(ddr.ddr_status(reports), ddr.ddr_activities(reports)).collect())) and rows
    assert sorted(map(str, shared.collect())) == sorted(map(str, reports.collect()))
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("from_xml") == 1 and plan.count("ReusedExchange") == 1


def test_many_numbers_as_one_by_one(spark):
    texts = ["1", " 2.5\t", "-999.25", "-9999", "-9999.0", "-999.99", "+.5e3", "1d", "NaN", "Infinity", "", " ", "1,5", None, "1e400", "-0.0"]
    rows = spark.createDataFrame([(t, u) for t in texts for u in texts], "a string, b string")
    got = rows.select(numbers.clean_floats_witsml([F.col("a"), F.col("b")]).alias("n"), numbers.clean_float_witsml(F.col("a")).alias("a"), numbers.clean_float_witsml(F.col("b")).alias("b"))
    assert all(str(r.n) == str([r.a, r.b]) for r in got.collect())


def test_mudlog_tests_each_number_once(spark, witsml_dir):
    plan = witsml.read_witsml(spark, witsml_dir)["witsml_mudlog"]._jdf.queryExecution().optimizedPlan().toString()
    # One for all numbers and two for the names of sections, of elements and of wellbores.
    assert plan.count("RLIKE") <= 3, plan.count("RLIKE")
