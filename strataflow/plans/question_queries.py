"""Queries for the field questions."""

from __future__ import annotations

from ..operators import benchmarks as b
from ..operators import efficiency as e
from ..operators import questions as q
from .benchmark_queries import QUALITY_TORQUE, SECTION_CTE
from .registry import query, rounded, single
from .well_queries import BREAKDOWN, TIMED


def _timed(t):
    return e.timed_activities(t["ddr_activities_timed"])


@query(
    "x1_npt_ranking",
    ["ddr_activities"],
    TIMED
    + BREAKDOWN
    + """select well, round(npt_hrs, 6) as npt_hrs, round(total_hrs, 6) as total_hrs, round(npt_hrs / total_hrs * 100, 6) as npt_pct,
 row_number() over (order by npt_hrs / total_hrs desc nulls last, well) as npt_rank from s""",
)
def npt_ranking(t):
    return rounded(q.npt_ranking(e.time_breakdown(_timed(t))))


@query(
    "x2_weather_by_month",
    ["ddr_activities"],
    TIMED + "select well, substr(date, 6, 2) as month, round(sum(hrs), 6) as hrs, count(*) as events from timed where cause = 'Weather' group by 1, 2",
)
def weather_by_month(t):
    return rounded(q.weather_by_month(_timed(t)))


@query(
    "x3_campaigns",
    ["ddr_status"],
    """, d as (select well, date, count(*) as reports, min(md_m) as lo, max(md_m) as hi from ddr_status group by well, date),
g as (select *, date_diff('day', cast(lag(date) over (partition by well order by date) as date), cast(date as date)) as idle from d),
n as (select *, sum(case when idle is null or idle > 3 then 1 else 0 end) over (partition by well order by date rows unbounded preceding) as campaign_no from g)
select well, cast(campaign_no as bigint) as campaign_no, min(date) as from_date, max(date) as to_date, cast(sum(reports) as bigint) as reports, round(min(lo), 6) as md_min, round(max(hi), 6) as md_max,
 cast(max(case when idle > 3 then idle end) as int) as idle_days_before from n group by well, campaign_no""",
)
def campaigns(t):
    return rounded(q.campaigns(t["ddr_status"], gap_days=3), 6)


@query(
    "x4_flat_stretches",
    ["ddr_status"],
    """, d as (select well, date, max(md_m) as md from ddr_status where md_m <> 0 group by well, date),
g as (select *, md - lag(md) over (partition by well order by date) as gain from d),
n as (select *, sum(case when abs(gain) <= 200 then 0 else 1 end) over (partition by well order by date rows unbounded preceding) as stretch_no from g)
select well, cast(stretch_no as bigint) as stretch_no, min(date) as from_date, max(date) as to_date, count(*) as days, round(min(md), 6) as md_min, round(max(md), 6) as md_max
from n group by well, stretch_no having count(*) >= 2""",
)
def flat_stretches(t):
    return rounded(q.flat_stretches(t["ddr_status"], max_gain_m=200.0), 6)


MIDS = f"""
, ml as (select *, (coalesce(md_top_m, 0) + coalesce(md_bottom_m, 0)) / 2.0 as md_mid from witsml_mudlog where {QUALITY_TORQUE}),
tops1 as (select well, md_m, surface_name from (select *, row_number() over (partition by well, md_m order by top_no desc) as r from formation_tops where md_m is not null) where r = 1)
"""


@query(
    "x5_rop_by_formation",
    ["witsml_mudlog", "formation_tops"],
    MIDS
    + """, l as (select ml.well, rop_avg_m_per_hr, t.surface_name as formation from ml asof left join tops1 t on ml.well = t.well and ml.md_mid >= t.md_m)
select well, formation, cast(count(*) as bigint) as intervals, round(avg(rop_avg_m_per_hr), 6) as avg_rop from l group by well, formation""",
)
def rop_by_formation(t):
    return rounded(q.rop_by_formation(t["witsml_mudlog"], t["formation_tops"]))


@query(
    "x5_rop_by_lithology",
    ["witsml_mudlog"],
    f"""select lith_type, count(*) as intervals, round(avg(rop_avg_m_per_hr), 6) as avg_rop, round(avg(wob_avg_kN), 6) as avg_wob from witsml_mudlog where {QUALITY_TORQUE} group by lith_type""",
)
def rop_by_lithology(t):
    return rounded(q.rop_by_lithology(t["witsml_mudlog"]))


@query(
    "x6_run_performance",
    ["witsml_bha_runs", "witsml_mudlog"],
    f""", ml as (select *, (coalesce(md_top_m, 0) + coalesce(md_bottom_m, 0)) / 2.0 as md_mid from witsml_mudlog where {QUALITY_TORQUE})
select r.well, run_no, md_start_m, md_stop_m, count(ml.well) as intervals, cast(cast(avg(rop_avg_m_per_hr) as real) as double) as avg_rop, cast(cast(avg(wob_avg_kN) as real) as double) as avg_wob
from witsml_bha_runs r left join ml on ml.well = r.well and md_mid between md_start_m and md_stop_m group by all""",
)
def run_performance(t):
    return single(q.run_performance(t["witsml_bha_runs"], t["witsml_mudlog"]), "avg_rop", "avg_wob")


@query(
    "x7_parameter_correlations",
    ["witsml_mudlog"],
    f"""select well, count(*) as intervals, round(corr(rop_avg_m_per_hr, rpm_avg), 6) as rop_rpm, round(corr(rop_avg_m_per_hr, wob_avg_kN), 6) as rop_wob,
 round(corr(rop_avg_m_per_hr, mud_weight_sg), 6) as rop_mw from witsml_mudlog where {QUALITY_TORQUE} group by well""",
)
def parameter_correlations(t):
    return rounded(q.parameter_correlations(t["witsml_mudlog"]), 6)


@query(
    "x8_hard_intervals",
    ["ddr_status", "witsml_mudlog"],
    SECTION_CTE
    + """, h as (select * from hit where pick = 1), m as (select well, hole_diameter_in, avg(wob_avg_kN) as wm, stddev_pop(wob_avg_kN) as ws, avg(torque_avg_kNm) as tm,
  stddev_pop(torque_avg_kNm) as ts, avg(rop_avg_m_per_hr) as rm from h group by well, hole_diameter_in)
select k1, k2, k3, k4, h.well, h.hole_diameter_in, round(rop_avg_m_per_hr, 6) as rop_avg_m_per_hr from h join m on m.well = h.well and m.hole_diameter_in = h.hole_diameter_in
where wob_avg_kN > wm + ws and torque_avg_kNm > tm + ts and rop_avg_m_per_hr < 0.5 * rm""",
)
def hard_intervals(t):
    out = q.hard_intervals(t["witsml_mudlog"], t["ddr_status"])
    return rounded(out.select("k1", "k2", "k3", "k4", "well", "hole_diameter_in", "rop_avg_m_per_hr"), 6)


@query(
    "x9_change_points",
    ["witsml_mudlog", "formation_tops"],
    """, s as (select well, floor(md_top_m / 10) * 10 as step_md, avg(mud_weight_sg) as step_mean, count(*) as intervals from witsml_mudlog group by 1, 2),
g as (select *, step_mean - lag(step_mean) over (partition by well order by step_md) as change from s),
tops1 as (select well, md_m, surface_name from (select *, row_number() over (partition by well, md_m order by top_no desc) as r from formation_tops where md_m is not null) where r = 1),
c as (select * from g where abs(change) > 0.00103)
select c.well, c.step_md, round(step_mean, 6) as step_mean, intervals, round(change, 6) as change, case when c.step_md <> 0 then t.surface_name end as formation
from c asof left join tops1 t on c.well = t.well and c.step_md >= t.md_m""",
)
def change_points(t):
    out = q.change_points(t["witsml_mudlog"], t["formation_tops"], value="mud_weight_sg", jump=0.00103)
    return rounded(out)


@query(
    "x10_gas_near_kicks",
    ["ddr_activities", "witsml_mudlog"],
    """, b as (select well, (coalesce(md_top_m, 0) + coalesce(md_bottom_m, 0)) / 2.0 as mid, max(methane_avg_ppm) as peak from witsml_mudlog where methane_avg_ppm is not null group by 1, 2),
k as (select * from ddr_activities where activity_code like 'well_control%' and depth_m is not null and depth_m <> 0)
select event_id, k.well, date, round(depth_m, 6) as depth_m, round(max(peak), 6) as max_ch4 from k left join b on b.well = k.well and abs(mid - depth_m) <= 10 group by event_id, k.well, date, depth_m""",
)
def gas_near_kicks(t):
    return rounded(q.gas_near_kicks(t["ddr_activities"], t["witsml_mudlog"]), 6)


@query(
    "x11_npt_vs_production",
    ["ddr_activities", "production"],
    TIMED
    + BREAKDOWN
    + """, p as (select well, sum(bore_oil_vol) as cum_oil from production group by well), j as (select s.well, npt_hrs / total_hrs * 100 as npt_pct, cum_oil from s join p on p.well = s.well)
select well, round(npt_pct, 6) as npt_pct, round(cum_oil, 2) as cum_oil, round((select corr(npt_pct, cum_oil) from j), 6) as field_corr from j""",
)
def npt_vs_production(t):
    out = q.npt_vs_production(e.time_breakdown(_timed(t)), b.production_summary(t["production"]))
    return rounded(out, 6, cum_oil=2)


@query(
    "x12_rop_percentiles",
    ["ddr_status", "witsml_mudlog"],
    SECTION_CTE
    + """, c as (select well, hole_diameter_in, rop_avg_m_per_hr as v, row_number() over (partition by well, hole_diameter_in order by rop_avg_m_per_hr) as r,
 count(*) over (partition by well, hole_diameter_in) as n from hit where pick = 1)
select well, hole_diameter_in, count(*) as intervals, round(min(case when r * 100 >= n * 10 then v end), 6) as p10, round(min(case when r * 100 >= n * 50 then v end), 6) as p50,
 round(min(case when r * 100 >= n * 90 then v end), 6) as p90 from c group by well, hole_diameter_in""",
)
def rop_percentiles(t):
    return rounded(q.rop_percentiles(t["witsml_mudlog"], t["ddr_status"]), 6)


@query(
    "x13_progress_vs_rop",
    ["ddr_status", "witsml_mudlog"],
    SECTION_CTE
    + """, d as (select well, hole_diameter_in, date, sum(dist_drill_m) as dist_m from ddr_status where hole_diameter_in is not null and dist_drill_m > 0 group by all),
p as (select well, hole_diameter_in, avg(dist_m) as m_per_day, count(*) as days from d group by well, hole_diameter_in),
r as (select well, hole_diameter_in, avg(rop_avg_m_per_hr) as avg_rop from hit where pick = 1 group by well, hole_diameter_in)
select p.well, p.hole_diameter_in, round(m_per_day, 6) as m_per_day, days, round(avg_rop, 6) as avg_rop, round(m_per_day / avg_rop, 6) as drilling_hrs_per_day
from p join r on p.well = r.well and p.hole_diameter_in = r.hole_diameter_in""",
)
def progress_vs_rop(t):
    return rounded(q.progress_vs_rop(t["ddr_status"], t["witsml_mudlog"]))


@query(
    "x14_delivery_time",
    ["wellbore_info"],
    """select well, min(date) as spud, max(date) as complete, cast(date_diff('day', cast(min(date) as date), cast(max(date) as date)) as int) as delivery_days from wellbore_info group by well""",
)
def delivery_time(t):
    # The test table has no spud and completion columns; its report dates stand in for both.
    return q.delivery_time(t["wellbore_info"], "date", "date")
