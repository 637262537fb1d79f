"""Queries over depth: as-of, nearest and interval joins, assemblies, issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bha as h
from ..operators import intervals as iv
from ..operators import issues as i
from ..operators.formation import tops_or_parent
from .benchmark_queries import QUALITY, QUALITY_TORQUE
from .registry import query, rounded, single
from .well_queries import TIMED

# ------------------------------------------------------------- depth joins

FORMATION_CTE = """
, probes as (select distinct well, depth_m from ddr_activities where depth_m is not null and depth_m <> 0),
tops1 as (select well, md_m, surface_name from (select *, row_number() over (partition by well, md_m order by top_no desc) as r from formation_tops where md_m is not null) where r = 1),
formation as (select p.well, p.depth_m, t.surface_name as formation from probes p asof left join tops1 t on p.well = t.well and p.depth_m >= t.md_m)
"""


@query(
    "j2_asof_formation",
    ["ddr_activities", "formation_tops"],
    FORMATION_CTE
    + """select event_id, a.well, round(a.depth_m, 6) as depth_m, formation from ddr_activities a
left join formation f on f.well = a.well and f.depth_m = a.depth_m""",
)
def asof_formation(t):
    out = i.formation_at(t["ddr_activities"], t["formation_tops"])
    return rounded(out.select("event_id", "well", "depth_m", "formation"), 6)


@query(
    "j3_asof_neighbors",
    ["ddr_activities", "formation_tops"],
    """, probes as (select distinct well, depth_m from ddr_activities where depth_m is not null),
o as (select *, lag(surface_name) over w as above_name, lag(md_m) over w as above_m from formation_tops where md_m is not null window w as (partition by well order by md_m, top_no)),
cur as (select * from (select *, row_number() over (partition by well, md_m order by top_no desc) as r from o) where r = 1),
nxt as (select * from (select *, row_number() over (partition by well, md_m order by top_no) as r from o) where r = 1),
f as (select p.well, p.depth_m, c.surface_name as current_name, c.md_m as current_m, c.above_name, c.above_m
  from probes p asof left join cur c on p.well = c.well and p.depth_m >= c.md_m),
g as (select p.well, p.depth_m, n.surface_name as below_name, n.md_m as below_m from probes p asof left join nxt n on p.well = n.well and p.depth_m < n.md_m)
select event_id, a.well, round(a.depth_m, 6) as depth_m, current_name, current_m, above_name, above_m, below_name, below_m
from ddr_activities a left join f on f.well = a.well and f.depth_m = a.depth_m left join g on g.well = a.well and g.depth_m = a.depth_m""",
)
def asof_neighbors(t):
    probes = t["ddr_activities"].select("event_id", "well", "depth_m")
    out = iv.asof_neighbors(probes, t["formation_tops"], ["well"], "depth_m", "surface_name", "md_m", "top_no")
    return rounded(out, 6)


NEAREST_CTE = f"""
, pts as (select well, md_m, hole_diameter_in from (select *, row_number() over (partition by well, md_m order by date desc, report_no desc) as r
  from ddr_status where md_m is not null and md_m <> 0 and hole_diameter_in is not null and hole_diameter_in <> 0) where r = 1),
ml as (select *, (coalesce(md_top_m, 0) + coalesce(md_bottom_m, 0)) / 2.0 as md_mid from witsml_mudlog where {QUALITY_TORQUE}),
pr as (select distinct well, md_mid from ml),
b as (select pr.well, pr.md_mid, p.md_m as bm, p.hole_diameter_in as bh from pr asof left join pts p on pr.well = p.well and pr.md_mid >= p.md_m),
a as (select pr.well, pr.md_mid, p.md_m as am, p.hole_diameter_in as ah from pr asof left join pts p on pr.well = p.well and pr.md_mid <= p.md_m),
near as (select b.well, b.md_mid, case when am is null or md_gap <= am - b.md_mid then bh else ah end as hole_diameter_in,
   case when am is null or md_gap <= am - b.md_mid then md_gap else am - b.md_mid end as nearest_gap
  from (select *, md_mid - bm as md_gap from b) b join a on a.well = b.well and a.md_mid = b.md_mid)
"""


@query(
    "j4_nearest_hole",
    ["ddr_status", "witsml_mudlog"],
    NEAREST_CTE
    + """select k1, k2, k3, k4, ml.well, round(rop_avg_m_per_hr, 6) as rop_avg_m_per_hr, near.hole_diameter_in, round(nearest_gap, 6) as nearest_gap
from ml left join near on near.well = ml.well and near.md_mid = ml.md_mid""",
)
def nearest_hole(t):
    out = h.mudlog_with_hole(t["witsml_mudlog"], t["ddr_status"])
    return rounded(
        out.select("k1", "k2", "k3", "k4", "well", "rop_avg_m_per_hr", "hole_diameter_in", "nearest_gap"), 6
    )


ROP_CTE = f"""
, mlq as (select *, (coalesce(md_top_m, 0) + coalesce(md_bottom_m, 0)) / 2.0 as mid from witsml_mudlog where {QUALITY}),
pd as (select distinct well, depth_m from ddr_activities where depth_m is not null and depth_m <> 0),
inside as (select pd.well, pd.depth_m, count(*) as n, avg(rop_avg_m_per_hr) as r from pd join mlq on mlq.well = pd.well
  and md_top_m <> 0 and md_bottom_m <> 0 and md_top_m <= pd.depth_m and pd.depth_m <= md_bottom_m group by pd.well, pd.depth_m),
mids as (select * from (select well, mid, md_top_m, rop_avg_m_per_hr as r, row_number() over (partition by well, mid order by md_top_m, rop_avg_m_per_hr) as k from mlq) where k = 1),
up as (select pd.well, pd.depth_m, m.mid, m.md_top_m, m.r from pd asof left join mids m on m.well = pd.well and pd.depth_m >= m.mid),
dn as (select pd.well, pd.depth_m, m.mid, m.md_top_m, m.r from pd asof left join mids m on m.well = pd.well and pd.depth_m < m.mid),
rop as (select pd.well, pd.depth_m, coalesce(n, 0) as n_containing, coalesce(inside.r, case
   when dn.mid is null or pd.depth_m - up.mid < dn.mid - pd.depth_m then up.r
   when up.mid is null or pd.depth_m - up.mid > dn.mid - pd.depth_m then dn.r
   when up.md_top_m <= dn.md_top_m then up.r else dn.r end) as rop_at
  from pd left join inside on inside.well = pd.well and inside.depth_m = pd.depth_m
   left join up on up.well = pd.well and up.depth_m = pd.depth_m left join dn on dn.well = pd.well and dn.depth_m = pd.depth_m)
"""


@query(
    "j5_interval_rop",
    ["ddr_activities", "witsml_mudlog"],
    ROP_CTE
    + "select well, round(depth_m, 6) as depth_m, n_containing, cast(cast(rop_at as real) as double) as rop_avg_m_per_hr_at from rop",
)
def interval_rop(t):
    out = i.rop_at_depths(t["ddr_activities"], t["witsml_mudlog"])
    shown = out.select("well", F.round("depth_m", 6).alias("depth_m"), F.col("n_containing").cast("long").alias("n_containing"), "rop_avg_m_per_hr_at")
    return single(shown, "rop_avg_m_per_hr_at")


@query(
    "j8_date_lookups",
    ["ddr_activities_aligned", "ddr_status", "ddr_fluids"],
    """, h as (select well, date, hole_diameter_in from (select *, row_number() over (partition by well, date order by report_no desc) as r from ddr_status) where r = 1),
m as (select well, date, density_gcc from (select *, row_number() over (partition by well, date order by sample_no desc) as r from ddr_fluids) where r = 1)
select event_id, a.well, a.date, hole_diameter_in, round(density_gcc, 6) as density_gcc from ddr_activities_aligned a
left join h on h.well = a.well and h.date = a.date left join m on m.well = a.well and m.date = a.date""",
)
def date_lookups(t):
    out = (
        t["ddr_activities_aligned"]
        .select("event_id", "well", "date")
        .join(i.last_per_day(t["ddr_status"], "hole_diameter_in", "report_no"), ["well", "date"], "left")
        .join(i.last_per_day(t["ddr_fluids"], "density_gcc", "sample_no"), ["well", "date"], "left")
    )
    return rounded(out, 6)


@query(
    "j11_parent_fallback",
    ["formation_tops"],
    """, wanted as (select distinct well || suffix as well, well as base, suffix from formation_tops, (values (''), ('_T2'), ('_A_B')) s(suffix))
select wanted.well, top_no, surface_name, md_m from wanted join formation_tops t on t.well = wanted.base""",
)
def parent_fallback(t):
    tops = t["formation_tops"]
    wanted = tops.select("well").distinct().select(
        F.explode(F.array(*[F.concat("well", F.lit(s)) for s in ("", "_T2", "_A_B")])).alias("well")
    )
    return tops_or_parent(wanted, tops).select("well", "top_no", "surface_name", "md_m")


# -------------------------------------------------------------- assemblies


@query(
    "t6_bha_runs_list",
    ["witsml_bha_runs"],
    "select *, row_number() over (partition by well order by start_time nulls last, run_no) as run_index from witsml_bha_runs",
)
def bha_runs_list(t):
    return h.runs_by_start(t["witsml_bha_runs"], ["run_no"])


@query(
    "f4_filtered_count",
    ["witsml_mudlog"],
    f"""select well, count(*) filter (where rop_avg_m_per_hr is not null) as raw_rows, count(*) filter (where {QUALITY_TORQUE}) as kept_rows,
 count(*) filter (where rop_avg_m_per_hr is not null) - count(*) filter (where {QUALITY_TORQUE}) as filtered_rows from witsml_mudlog group by well""",
)
def filtered_count(t):
    return h.filtered_count(t["witsml_mudlog"])


SECTIONS = NEAREST_CTE + """, sec as (select ml.*, near.hole_diameter_in as hole from ml left join near on near.well = ml.well and near.md_mid = ml.md_mid),
agg as (select well, hole as hole_diameter_in, cast(count(*) as bigint) as intervals, min(md_top_m) as md_min, max(md_bottom_m) as md_max, avg(rop_avg_m_per_hr) as avg_rop,
  avg(wob_avg_kN) as avg_wob, avg(torque_avg_kNm) as avg_torque, avg(rpm_avg) as avg_rpm, avg(mud_weight_sg) as avg_mw, avg(ecd_sg) as avg_ecd,
  min(rop_avg_m_per_hr) as min_rop, max(rop_avg_m_per_hr) as max_rop from sec group by well, hole)
"""
_SEC_COLS = """well, hole_diameter_in, intervals, md_min, md_max, cast(cast(avg_rop as real) as double) as avg_rop, cast(cast(avg_wob as real) as double) as avg_wob,
 cast(cast(avg_torque as real) as double) as avg_torque, cast(cast(avg_rpm as real) as double) as avg_rpm, cast(cast(avg_mw as real) as double) as avg_mw, cast(cast(avg_ecd as real) as double) as avg_ecd,
 cast(cast(min_rop as real) as double) as min_rop, cast(cast(max_rop as real) as double) as max_rop"""


@query("a12_mudlog_section_stats", ["ddr_status", "witsml_mudlog"], SECTIONS + f"select {_SEC_COLS} from agg")
def mudlog_section_stats(t):
    out = h.mudlog_section_stats(t["witsml_mudlog"], t["ddr_status"])
    return single(out, *[c for c, kind in out.dtypes if kind == "double" and c != "hole_diameter_in"])


@query(
    "t2_performance_ranking",
    ["ddr_status", "witsml_mudlog"],
    SECTIONS
    + "select well, hole_diameter_in, round(avg_rop, 8) as avg_rop, cast(rank() over (partition by well order by avg_rop desc) as int) as rop_rank from agg",
)
def performance_ranking(t):
    out = h.performance_ranking(h.mudlog_section_stats(t["witsml_mudlog"], t["ddr_status"]))
    return rounded(out.select("well", "hole_diameter_in", "avg_rop", "rop_rank"), 8)


@query(
    "a13_lithology_by_section",
    ["ddr_status", "witsml_mudlog"],
    SECTIONS
    + """select * from (select well, hole as hole_diameter_in, coalesce(nullif(lith_type, ''), 'unknown') as lith_type, cast(count(*) as bigint) as cnt,
 cast(row_number() over (partition by well, hole order by count(*) desc, coalesce(nullif(lith_type, ''), 'unknown')) as int) as rank_no from sec group by 1, 2, 3) where rank_no <= 3""",
)
def lithology_by_section(t):
    return h.lithology_by_section(t["witsml_mudlog"], t["ddr_status"])


DDR_SECTIONS = """
, ds as (select well, hole_diameter_in, count(*) as n_days, sum(dist_drill_m) as total_m, avg(dist_drill_m) as avg_m_per_day, min(md_m) as md_min, max(md_m) as md_max
  from ddr_status where hole_diameter_in is not null and hole_diameter_in <> 0 and dist_drill_m > 0 group by well, hole_diameter_in)
"""


@query(
    "a14_ddr_section_performance",
    ["ddr_status"],
    DDR_SECTIONS
    + """select well, hole_diameter_in, n_days, round(total_m, 8) as total_m, round(avg_m_per_day, 8) as avg_m_per_day,
 round(md_min, 8) as md_min, round(md_max, 8) as md_max from ds""",
)
def ddr_section_performance(t):
    return rounded(h.ddr_section_performance(t["ddr_status"]), 8)


@query(
    "a14_section_extremes",
    ["ddr_status"],
    DDR_SECTIONS
    + """, r as (select *, row_number() over (partition by well order by avg_m_per_day desc, md_min) as b, row_number() over (partition by well order by avg_m_per_day, md_min) as s, count(*) over (partition by well) as n from ds)
select well, n as n_sections, max(case when b = 1 then hole_diameter_in end) as best_hole, round(max(avg_m_per_day), 6) as best_m_per_day,
 max(case when s = 1 then hole_diameter_in end) as slowest_hole, round(min(avg_m_per_day), 6) as slowest_m_per_day from r where n > 1 group by well, n""",
)
def section_extremes(t):
    return rounded(h.section_extremes(h.ddr_section_performance(t["ddr_status"])))


@query(
    "r6_bha_comment_evidence",
    ["ddr_activities"],
    """, hits as (select *, row_number() over (partition by well order by date, start_ts, event_id) as r, count(*) over (partition by well) as n
  from ddr_activities where regexp_matches(lower(comments), 'bha|bit|pick up|p/u|tripped out|pooh|new assembly'))
select well, cast(r as int) as rank_no, date, round(depth_m, 6) as depth_m, activity_code, event_id, substr(comments, 1, 180) as comment, n as n_mentions from hits where r <= 10""",
)
def bha_comment_evidence(t):
    return rounded(h.bha_comments(t["ddr_activities"]), 6)


@query(
    "a27_bha_confidence",
    ["witsml_bha_runs", "witsml_mudlog", "ddr_status"],
    f"""select w.well, coalesce(r.n, 0) as bha_runs, coalesce(m.n, 0) as mudlog_intervals,
 case when coalesce(r.n, 0) > 0 and coalesce(m.n, 0) > 0 then 'HIGH' when coalesce(r.n, 0) > 0 then 'MEDIUM' else 'LOWER' end as confidence
from (select distinct well from ddr_status) w left join (select well, count(*) as n from witsml_bha_runs group by well) r on r.well = w.well
left join (select well, count(*) as n from witsml_mudlog where {QUALITY_TORQUE} group by well) m on m.well = w.well""",
)
def bha_confidence(t):
    return h.bha_confidence(t["witsml_bha_runs"], t["witsml_mudlog"], t["ddr_status"])


# ------------------------------------------------------------------ issues

ISSUE_WHERE = """state = 'problem' or activity_code like 'interruption%' or activity_code like 'well_control%'
  or state_detail in ('equipment failure', 'mud loss', 'operation failed')
  or regexp_matches(lower(comments), 'kick|influx|shut in|well control|flow check|blowout')"""
CATEGORY = """case when activity_code like '%well_control%' or regexp_matches(lower(coalesce(comments, '')), 'kick|influx|well control|blowout|shut in well') then 'Well Control'
   when activity_code like '%repair%' or lower(activity_code) like '%maintain%' then 'Equipment Repair'
   when activity_code like '%waiting%' and activity_code like '%weather%' then 'Weather Delay'
   when activity_code like '%waiting%' then 'Waiting/Delay'
   when state_detail like '%equipment failure%' then 'Equipment Failure'
   when state_detail like '%mud loss%' or (lower(coalesce(comments, '')) like '%loss%' and lower(coalesce(comments, '')) like '%circulat%') then 'Mud Losses'
   when lower(coalesce(comments, '')) like '%stuck%' then 'Stuck Pipe'
   when lower(coalesce(comments, '')) like '%flow check%' then 'Flow Check'
   when state_detail like '%operation failed%' then 'Operational Difficulty' else 'Other Issue' end"""


def issues_cte(view: str = "ddr_activities") -> str:
    return f", iss as (select *, {CATEGORY} as category from {view} where {ISSUE_WHERE})\n"


@query(
    "f5_issue_rows",
    ["ddr_activities"],
    issues_cte() + "select event_id, well, date, activity_code, category from iss",
)
def issue_rows(t):
    return i.issue_rows(t["ddr_activities"]).select("event_id", "well", "date", "activity_code", "category")


@query(
    "a15_issue_summary",
    ["ddr_activities"],
    issues_cte()
    + """select iss.well, category, count(*) as cnt, any_value(n) as total_activities, round(count(*) * 100.0 / any_value(n), 6) as pct_of_activities
from iss join (select well, count(*) as n from ddr_activities group by well) a on a.well = iss.well group by iss.well, category""",
)
def issue_summary(t):
    return rounded(i.issue_counts(t["ddr_activities"]), 6)


@query(
    "t4_first_events",
    ["ddr_activities"],
    issues_cte()
    + """select * from (select well, category, cast(row_number() over (partition by well, category order by date, start_ts, event_id) as int) as rank_no, date,
 round(depth_m, 6) as depth_m, event_id, substr(coalesce(comments, ''), 1, 200) as comment from iss) where rank_no <= 3""",
)
def first_events(t):
    return rounded(i.first_events(i.issue_rows(t["ddr_activities"])), 6)


@query(
    "t3_issue_timeline",
    ["ddr_activities"],
    TIMED
    + f""", iss as (select *, {CATEGORY} as category from timed where {ISSUE_WHERE})
select * from (select well, cast(row_number() over (partition by well order by date, start_ts, event_id) as int) as rank_no, date, round(depth_m, 6) as depth_m, category, event_id,
 round(hrs, 6) as duration_hrs, substr(coalesce(comments, ''), 1, 150) as comment from iss) where rank_no <= 25""",
)
def issue_timeline(t):
    return rounded(i.issue_timeline(i.issue_rows(t["ddr_activities_timed"])), 6)


@query(
    "a16_contributing_factors",
    ["ddr_activities", "ddr_activities_aligned", "ddr_status", "ddr_fluids", "formation_tops", "witsml_mudlog"],
    issues_cte("ddr_activities_aligned")
    + FORMATION_CTE
    + ROP_CTE
    + """, ev as (select well, category, count(*) as events from iss group by well, category having count(*) >= 2),
hd as (select well, date, hole_diameter_in from (select *, row_number() over (partition by well, date order by report_no desc) as r from ddr_status) where r = 1),
md as (select well, date, density_gcc from (select *, row_number() over (partition by well, date order by sample_no desc) as r from ddr_fluids) where r = 1),
dd as (select iss.well, category, string_agg(distinct cast(hole_diameter_in as varchar), '|') filter (where hole_diameter_in <> 0) as holes0,
  list_sort(list(distinct hole_diameter_in) filter (where hole_diameter_in <> 0)) as hl,
  min(nullif(density_gcc, 0)) as density_min, max(nullif(density_gcc, 0)) as density_max
  from iss left join hd on hd.well = iss.well and hd.date = iss.date left join md on md.well = iss.well and md.date = iss.date group by iss.well, category),
dp as (select iss.well, category, min(iss.depth_m) as depth_min, max(iss.depth_m) as depth_max, string_agg(distinct formation, '|' order by formation) as formations,
  avg(case when rop_at <> 0 then rop_at end) as rop_at_issues
  from iss left join formation on formation.well = iss.well and formation.depth_m = iss.depth_m left join rop on rop.well = iss.well and rop.depth_m = iss.depth_m
  where iss.depth_m is not null and iss.depth_m <> 0 group by iss.well, category),
wr as (select well, avg(rop_avg_m_per_hr) as rop_well from mlq group by well)
select ev.well, ev.category, events, coalesce(array_to_string([cast(x as varchar) for x in hl], '|'), '') as holes,
 round(density_min, 8) as density_min, round(density_max, 8) as density_max, round(depth_min, 8) as depth_min, round(depth_max, 8) as depth_max,
 coalesce(formations, '') as formations, round(rop_at_issues, 8) as rop_at_issues, round(rop_well, 8) as rop_well,
 case when rop_at_issues is null or rop_well is null then null when rop_at_issues > rop_well * 1.1 then 'above' when rop_at_issues < rop_well * 0.9 then 'below' else 'near' end as rop_vs_well
from ev left join dd on dd.well = ev.well and dd.category = ev.category left join dp on dp.well = ev.well and dp.category = ev.category left join wr on wr.well = ev.well""",
)
def contributing_factors(t):
    out = i.contributing_factors(
        i.issue_rows(t["ddr_activities_aligned"]),
        t["ddr_status"],
        t["ddr_fluids"],
        t["formation_tops"],
        t["witsml_mudlog"],
    )
    return rounded(out, 8)


@query(
    "a17_mud_problem_vs_normal",
    ["ddr_activities_aligned", "ddr_fluids"],
    issues_cte("ddr_activities_aligned")
    + """, days as (select distinct well, date from iss),
fl as (select f.*, days.date is not null as problem from ddr_fluids f left join days on days.well = f.well and days.date = f.date),
l as (select well, problem, 'density_gcc' as property, density_gcc as v from fl union all select well, problem, 'pv_mPas', pv_mPas from fl union all select well, problem, 'yp_Pa', yp_Pa from fl),
g as (select well, property, count(*) filter (where problem and v <> 0) as n_problem, count(*) filter (where not problem and v <> 0) as n_normal,
  avg(v) filter (where problem and v <> 0) as avg_problem, avg(v) filter (where not problem and v <> 0) as avg_normal from l group by well, property)
select well, property, n_problem, n_normal, round(avg_problem, 6) as avg_problem, round(avg_normal, 6) as avg_normal,
 round((avg_problem - avg_normal) / avg_normal * 100, 6) as diff_pct, abs((avg_problem - avg_normal) / avg_normal * 100) > 5 as notable
from g where n_problem > 0 and n_normal > 0""",
)
def mud_problem_vs_normal(t):
    out = i.mud_problem_vs_normal(t["ddr_fluids"], i.issue_rows(t["ddr_activities_aligned"]))
    return rounded(out)


@query(
    "j9_semi_anti_by_date",
    ["ddr_activities_aligned", "ddr_fluids"],
    issues_cte("ddr_activities_aligned")
    + """select f.well, sample_no, f.date, case when exists (select 1 from iss where iss.well = f.well and iss.date = f.date) then 'problem' else 'normal' end as day_kind from ddr_fluids f""",
)
def semi_anti_by_date(t):
    problem, normal = i.mud_on_problem_days(t["ddr_fluids"], i.issue_rows(t["ddr_activities_aligned"]))
    cols = ["well", "sample_no", "date"]
    return problem.select(*cols, F.lit("problem").alias("day_kind")).unionByName(
        normal.select(*cols, F.lit("normal").alias("day_kind"))
    )


_TREND_TAIL = """case when second_half > first_half * 1.3 then 'INCREASING' when second_half < first_half * 0.7 then 'DECREASING' else 'STABLE' end as trend"""


@query(
    "a18_issue_trend",
    ["ddr_activities_aligned"],
    issues_cte("ddr_activities_aligned")
    + """, r as (select *, row_number() over (partition by well order by date, start_ts, event_id) as rn, count(*) over (partition by well) as n from iss),
h as (select well, any_value(n) as total, any_value(n) // 2 as first_half, any_value(n) - any_value(n) // 2 as second_half, min(date) as first_from,
  max(case when rn = n // 2 then date end) as first_to, max(case when rn = n // 2 + 1 then date end) as second_from, max(date) as second_to from r where n > 5 group by well)
select *, """
    + _TREND_TAIL
    + " from h",
)
def issue_trend(t):
    return i.issue_trend(i.issue_rows(t["ddr_activities_aligned"]))


@query(
    "a18_issue_trend_by_time",
    ["ddr_activities_aligned"],
    issues_cte("ddr_activities_aligned")
    + """, b as (select well, count(*) as total, min(date) as lo, max(date) as hi from iss group by well having count(*) > 5),
e as (select iss.*, total, lo, hi, date_diff('day', cast(lo as date), cast(date as date)) * 2 < date_diff('day', cast(lo as date), cast(hi as date)) as early from iss join b on b.well = iss.well),
h as (select well, any_value(total) as total, count(*) filter (where early) as first_half, count(*) filter (where not early) as second_half, min(date) as first_from,
  max(date) filter (where early) as first_to, min(date) filter (where not early) as second_from, max(date) as second_to from e group by well)
select *, """
    + _TREND_TAIL
    + " from h",
)
def issue_trend_by_time(t):
    return i.issue_trend(i.issue_rows(t["ddr_activities_aligned"]), by_time=True)


@query(
    "r5_problem_summaries",
    ["ddr_status"],
    """select well, cast(r as int) as rank_no, date, report_no, round(md_m, 6) as md_m, substr(summary_24hr, 1, 200) as excerpt from (
 select *, row_number() over (partition by well order by date, report_no) as r from ddr_status
 where regexp_matches(summary_24hr, 'problem|issue|failure|stuck|loss|kick|repair|wait')) where r <= 5""",
)
def problem_summaries(t):
    return rounded(i.problem_summaries(t["ddr_status"]), 6)
