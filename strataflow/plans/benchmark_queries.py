"""Queries over the field benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import fixed_mean
from ..operators import benchmarks as b
from .registry import mean_sql, query, rounded

QUALITY = """rop_avg_m_per_hr is not null and rop_avg_m_per_hr > 0 and rop_avg_m_per_hr <= 200
 and (rpm_avg is null or (rpm_avg > 0 and rpm_avg <= 300))
 and (wob_avg_kN is null or (wob_avg_kN > 0 and wob_avg_kN <= 500))"""
QUALITY_TORQUE = QUALITY + " and (torque_avg_kNm is null or (torque_avg_kNm > 0 and torque_avg_kNm <= 100))"

SEVERE_SQL = " or ".join(
    f"lower(coalesce(comments, '')) like '%{word}%'"
    for word in (
        "stuck", "tight hole", "pack off", "packing-off", "lost circulation", "mud loss",
        "losses", "kick", "influx", "cavings", "slough",
    )
)

RISK_CTE = f"""
, acts as (select well,
   cast(count(*) filter (where activity_code like 'interruption%') as bigint) as interruptions,
   cast(count(*) filter (where {SEVERE_SQL}) as bigint) as severe_mentions,
   cast(count(*) filter (where activity_code like 'well_control%') as bigint) as well_control,
   cast(count(*) filter (where lower(coalesce(comments, '')) like '%fish%') as bigint) as fishing_mentions,
   cast(count(*) as bigint) as total_activities
  from ddr_activities group by well),
perf as (select well, count(*) as perf_count, max(md_base_m) as deepest_perf_md from perforations group by well),
risk as (select acts.*, coalesce(perf_count, 0) as perf_count, coalesce(deepest_perf_md, 0) as deepest_perf_md,
   round(severe_mentions*3.0 + well_control*5.0 + fishing_mentions*2.0 + interruptions*cast(0.05 as double)
     + case when coalesce(perf_count, 0) > 0 then 1.0 else 0.0 end, 6) as risk_score
  from acts left join perf on acts.well = perf.well)
"""


@query("a23_risk_benchmark", ["ddr_activities", "perforations"], RISK_CTE + "select * from risk")
def risk_benchmark(t):
    return rounded(b.risk(t["ddr_activities"], t["perforations"]))


@query(
    "t1_risk_top_bottom",
    ["ddr_activities", "perforations"],
    RISK_CTE
    + """, r as (select *, row_number() over (order by risk_score desc, well) as up,
   row_number() over (order by risk_score, well desc) as down, count(*) over () as n from risk)
select 'top' as band, cast(up as int) as rank_no, well, risk_score, severe_mentions, interruptions from r where up <= 5
union all select 'bottom', cast(down as int), well, risk_score, severe_mentions, interruptions from r where down <= 5 and n > 5""",
)
def risk_top_bottom(t):
    out = b.field_benchmarks(t, "risk")
    return rounded(
        out.select("band", "rank_no", "well", "risk_score", "severe_mentions", "interruptions")
    )


@query(
    "a19_daily_progress",
    ["ddr_status"],
    """, daily as (select well, hole_diameter_in, date, sum(dist_drill_m) as dist_m from ddr_status
  where hole_diameter_in is not null and coalesce(dist_drill_m, 0) > 0 group by all)
select well, hole_diameter_in, round(avg(dist_m), 6) as avg_daily_m, count(*) as drilling_days,
 round(sum(dist_m), 2) as total_m from daily group by well, hole_diameter_in having count(*) >= 2""",
)
def daily_progress_benchmark(t):
    return rounded(b.daily_progress(t["ddr_status"]), total_m=2)


SECTION_CTE = f"""
, bounds as (select well, hole_diameter_in, min(md_m) as md_min, max(md_m) as md_max from ddr_status
  where hole_diameter_in is not null group by well, hole_diameter_in),
ml as (select *, row_number() over () as rid, (coalesce(md_top_m, 0) + coalesce(md_bottom_m, 0)) / 2.0 as mid
  from witsml_mudlog where {QUALITY_TORQUE}),
hit as (select ml.*, hole_diameter_in, md_min, md_max,
   row_number() over (partition by rid order by md_max - md_min, hole_diameter_in desc) as pick
  from ml join bounds on ml.well = bounds.well and md_min <= mid and mid <= md_max),
sec as (select well, hole_diameter_in, md_min, md_max, count(*) as intervals, avg(rop_avg_m_per_hr) as avg_rop,
   coalesce(avg(wob_avg_kN), 0) as avg_wob, coalesce(avg(torque_avg_kNm), 0) as avg_torque,
   coalesce(avg(rpm_avg), 0) as avg_rpm, coalesce(avg(mud_weight_sg), 0) as avg_mw,
   coalesce(avg(ecd_sg), 0) as avg_ecd, coalesce(avg(methane_avg_ppm), 0) as avg_ch4
  from hit where pick = 1 group by well, hole_diameter_in, md_min, md_max having count(*) >= 10)
"""


@query(
    "a20_section_performance",
    ["ddr_status", "witsml_mudlog"],
    SECTION_CTE
    + """, f as (select count(*) as n, avg(avg_wob) as mw, stddev_pop(avg_wob) as sw, avg(avg_torque) as mt,
   stddev_pop(avg_torque) as st, avg(avg_rop) as mr, stddev_pop(avg_rop) as sr from sec)
select well, hole_diameter_in, round(md_min, 6) as md_min, round(md_max, 6) as md_max, intervals,
 round(avg_rop, 6) as avg_rop, round(avg_wob, 6) as avg_wob, round(avg_torque, 6) as avg_torque,
 round(avg_rpm, 6) as avg_rpm, round(avg_mw, 6) as avg_mw, round(avg_ecd, 6) as avg_ecd, round(avg_ch4, 6) as avg_ch4,
 round(case when n < 2 or sw = 0 then 0 else (avg_wob - mw) / sw end
  + case when n < 2 or st = 0 then 0 else (avg_torque - mt) / st end
  - case when n < 2 or sr = 0 then 0 else (avg_rop - mr) / sr end, 6) as difficulty_index
from sec cross join f""",
)
def section_performance(t):
    out = b.section_performance(t["witsml_mudlog"], t["ddr_status"])
    return rounded(out, md_min=6, md_max=6)


@query(
    "j6_assign_to_window",
    ["ddr_status", "witsml_mudlog"],
    SECTION_CTE
    + """select k1, k2, k3, k4, round(rop_avg_m_per_hr, 6) as rop_avg_m_per_hr, well, hole_diameter_in
from hit where pick = 1""",
)
def assign_to_window(t):
    out = b.mudlog_in_sections(t["witsml_mudlog"], t["ddr_status"])
    return rounded(
        out.select("k1", "k2", "k3", "k4", "rop_avg_m_per_hr", "well", "hole_diameter_in"), 6
    )


FORMATION_CTE = """
, named as (select well, lower(surface_name) as s, md_m from formation_tops where lower(surface_name) like '%hugin%'),
picked as (select well, coalesce(min(case when s like '%top%' then md_m end), min(md_m)) as top_md,
  max(case when s like '%base%' then md_m end) as base from named group by well),
win0 as (select p.well, p.top_md, coalesce(p.base,
   (select min(t.md_m) from formation_tops t where t.well = p.well and t.md_m > p.top_md), p.top_md + 400.0) as b
  from picked p where p.top_md is not null),
win as (select well, top_md, case when b <= top_md then top_md + 400.0 else b end as base_md from win0)
"""


@query("a21_formation_window", ["formation_tops"], FORMATION_CTE + "select * from win")
def formation_window(t):
    return b.formation_window(t["formation_tops"], "Hugin")


@query(
    "a21_formation_window_without_base",
    ["formation_tops"],
    FORMATION_CTE.replace("%hugin%", "%draupne%") + "select * from win",
)
def formation_window_without_base(t):
    return b.formation_window(t["formation_tops"], "Draupne")


IN_FORMATION_CTE = FORMATION_CTE + """, inside as (select m.*, top_md, base_md from witsml_mudlog m
  join win on m.well = win.well and m.md_top_m >= top_md and m.md_bottom_m <= base_md)
"""


@query(
    "j7_formation_window_join",
    ["formation_tops", "witsml_mudlog"],
    IN_FORMATION_CTE
    + f"""select well, lith_type, count(*) as intervals, min(md_top_m) as md_min, max(md_bottom_m) as md_max,
 {mean_sql('rop_avg_m_per_hr')} as avg_rop from inside group by well, lith_type""",
)
def formation_window_join(t):
    rows = b.rows_in_formation(t["witsml_mudlog"], t["formation_tops"], "Hugin")
    return rounded(
        rows.groupBy("well", "lith_type").agg(
            F.count("*").alias("intervals"),
            F.min("md_top_m").alias("md_min"),
            F.max("md_bottom_m").alias("md_max"),
            fixed_mean("rop_avg_m_per_hr").alias("avg_rop"),
        )
    )


@query(
    "a22_gas_response",
    ["formation_tops", "witsml_mudlog"],
    IN_FORMATION_CTE
    + """, lith as (select well, lith_type, row_number() over (partition by well order by count(*) desc, lith_type) as r
  from inside where lith_type is not null group by well, lith_type)
select i.well, top_md, base_md, count(*) as intervals, round(max(methane_avg_ppm), 6) as max_ch4,
 round(max(ethane_avg_ppm), 6) as max_c2, round(avg(methane_avg_ppm), 6) as avg_ch4,
 round(coalesce(avg(ethane_avg_ppm), 0), 6) as avg_c2, coalesce(any_value(lith.lith_type), 'unknown') as dominant_lith
from inside i left join lith on lith.well = i.well and lith.r = 1
where methane_avg_ppm is not null group by i.well, top_md, base_md""",
)
def gas_response(t):
    out = b.gas_response(t["witsml_mudlog"], t["formation_tops"], "Hugin")
    return rounded(out, max_ch4=6, max_c2=6)


@query(
    "a24_production_summary",
    ["production"],
    """select well, count(*) as prod_days, round(sum(bore_oil_vol), 2) as cum_oil, round(sum(bore_gas_vol), 2) as cum_gas,
 round(sum(bore_wat_vol), 2) as cum_water, round(avg(avg_downhole_pressure), 6) as avg_pressure
from production group by well""",
)
def production_summary(t):
    return rounded(b.production_summary(t["production"]), cum_oil=2, cum_gas=2, cum_water=2)


@query(
    "j1_left_join_perforations",
    ["ddr_activities", "perforations"],
    """, a as (select well, count(*) as total_activities from ddr_activities group by well),
p as (select well, count(*) as perf_count, max(md_base_m) as deepest_perf_md from perforations group by well)
select a.well, total_activities, coalesce(perf_count, 0) as perf_count, coalesce(deepest_perf_md, 0) as deepest_perf_md
from a left join p on a.well = p.well""",
)
def left_join_perforations(t):
    counts = t["ddr_activities"].groupBy("well").agg(F.count("*").alias("total_activities"))
    return counts.join(b.perforation_counts(t["perforations"]), "well", "left").fillna(
        {"perf_count": 0, "deepest_perf_md": 0.0}
    )
