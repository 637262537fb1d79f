"""Queries over wells in time: overview, efficiency, phases, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as c
from ..operators import efficiency as e
from ..operators import overview as o
from ..operators import phases as p
from ..operators.ordered import union_all
from ..operators.questions import rank_wells
from .registry import mean_sql, query, rounded

# ---------------------------------------------------------------- overview


@query(
    "a1_well_summary",
    ["ddr_status"],
    """select well, min(date) as first_date, max(date) as last_date, count(distinct date) as num_reports,
 round(min(md_m), 6) as min_md, round(max(md_m), 6) as max_md, round(min(tvd_m), 6) as min_tvd, round(max(tvd_m), 6) as max_tvd
from ddr_status group by well""",
)
def well_summary(t):
    return rounded(o.well_summary(t["ddr_status"]), 6)


@query(
    "a1_drilled_range",
    ["ddr_status"],
    """select well, min(date) as first_date, max(date) as last_date, round(min(nullif(md_m, 0)), 6) as min_md,
 round(max(nullif(md_m, 0)), 6) as max_md from ddr_status group by well""",
)
def drilled_range(t):
    return rounded(o.drilled_range(t["ddr_status"]), 6)


@query(
    "a2_hole_sections",
    ["ddr_status"],
    """select well, hole_diameter_in, min(date) as from_date, max(date) as to_date, round(min(md_m), 6) as min_md,
 round(max(md_m), 6) as max_md, count(distinct date) as days from ddr_status
where hole_diameter_in is not null group by well, hole_diameter_in""",
)
def hole_sections(t):
    return rounded(o.hole_sections(t["ddr_status"]), 6)


@query(
    "a3_activity_distribution",
    ["ddr_activities"],
    """select well, activity_code, count(*) as cnt, cast(sum(case when state = 'problem' then 1 else 0 end) as bigint) as problems,
 round(count(*) * 100.0 / sum(count(*)) over (partition by well), 6) as pct
from ddr_activities where activity_code <> '' group by well, activity_code""",
)
def activity_distribution(t):
    return rounded(o.activity_distribution(t["ddr_activities"]), 6)


@query(
    "a4_wellbore_meta",
    ["wellbore_info"],
    """select well, date, name_well, name_wellbore, operator from (
 select *, row_number() over (partition by well order by date desc, report_no desc) as r from wellbore_info) where r = 1""",
)
def wellbore_meta(t):
    return o.wellbore_meta(t["wellbore_info"])


@query("a28_available_wells", ["ddr_status"], "select distinct well from ddr_status")
def available_wells(t):
    return o.available_wells(t["ddr_status"])


LISTED = {
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
}
_TYPE = "case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' else lower(column_type) end"


@query(
    "a28_table_schema",
    sql=" union all ".join(
        f"select '{n}' as table_name, cast({i} as int) as position, '{c}' as column_name, (select {_TYPE} from (describe {n}) where column_name = '{c}') as data_type, count({c}) as n_values from {n}"
        for n, columns in LISTED.items()
        for i, (c, _) in enumerate(columns)
    ),
)
def table_schema(t):
    """Columns of two source tables with their types and numbers of values."""
    sources = {n: t.source(n) for n in LISTED}
    return union_all([o.table_schema(sources, n).select(F.lit(n).alias("table_name"), "*") for n in LISTED])


COUNTED = [
    "ddr_status", "ddr_activities", "ddr_fluids", "ddr_surveys", "wellbore_info", "formation_tops", "perforations",
    "production", "witsml_bha_runs", "witsml_mudlog", "witsml_trajectory", "witsml_messages",
]


@query(
    "k2_table_counts",
    COUNTED,
    " union all ".join(f"select '{n}' as table_name, count(*) as row_count from {n}" for n in COUNTED),
)
def table_counts(t):
    return o.table_counts(t, COUNTED)


@query(
    "r7_formation_column",
    ["formation_tops"],
    "select well, top_no, surface_name, md_m from formation_tops",
)
def formation_column(t):
    return o.formation_column(t["formation_tops"])


@query(
    "r8_adhoc_sql",
    ["ddr_status", "ddr_activities"],
    """select s.well, hole_diameter_in, n_reports, n_problems from
 (select well, hole_diameter_in, count(*) as n_reports from ddr_status group by well, hole_diameter_in) s
 join (select well, count(*) as n_problems from ddr_activities where state = 'problem' group by well) a on s.well = a.well""",
)
def adhoc_sql(t):
    return o.run_sql(
        t,
        """select s.well, hole_diameter_in, n_reports, n_problems from
 (select well, hole_diameter_in, count(*) as n_reports from {ddr_status} group by well, hole_diameter_in) s
 join (select well, count(*) as n_problems from {ddr_activities} where state = 'problem' group by well) a on s.well = a.well;""",
    )


@query(
    "t5_result_cap",
    ["ddr_status"],
    """select well, report_no, date from ddr_status order by date desc, report_no desc limit 200""",
)
def result_cap(t):
    return o.run_sql(t, "select well, report_no, date from {ddr_status} order by date desc, report_no desc", cap=200)


@query("t5_own_limit", ["ddr_status"], "select well, report_no, date from ddr_status order by date, report_no limit 1000")
def own_limit(t):
    return o.run_sql(t, "select well, report_no, date from ddr_status order by date, report_no limit 1000;", cap=200)


@query(
    "t5_with_query_uncapped",
    ["ddr_status"],
    "select well, date, count(*) as n from ddr_status group by well, date",
)
def with_query(t):
    return o.run_sql(t, "with d as (select well, date from ddr_status) select well, date, count(*) as n from d group by well, date", cap=200)


@query(
    "t7_order_with_nulls",
    ["production"],
    """select well, round(sum(bore_wat_vol), 2) as cum_water, row_number() over (order by sum(bore_wat_vol) desc nulls last, well) as rank_no
from production group by well""",
)
def order_with_nulls(t):
    sums = t["production"].groupBy("well").agg(F.sum("bore_wat_vol").alias("cum_water"))
    return rounded(rank_wells(sums, "cum_water", "rank_no"), 2)


# -------------------------------------------------------------- efficiency

TIMED = """
, timed0 as (select *, coalesce(date_diff('microsecond', start_ts, end_ts) / 3.6e9, 0) as hrs,
   lower(coalesce(comments, '')) as cl from ddr_activities),
timed as (select *,
  case when activity_code in ('interruption -- repair', 'interruption -- waiting on weather', 'interruption -- waiting',
     'interruption -- other', 'interruption -- wait', 'interruption -- maintain', 'well_control -- kick',
     'well_control -- kill', 'well_control -- shut-in') then 'npt'
   when activity_code in ('drilling -- drill', 'drilling -- ream', 'drilling -- coring', 'cementing -- cement',
     'cementing -- casing', 'completion -- completion', 'logging -- log') then 'productive'
   when activity_code like '%trip%' then 'trip' else 'other' end as time_class,
  case activity_code when 'interruption -- repair' then 'Equipment Repair' when 'interruption -- waiting on weather' then 'Weather'
   when 'interruption -- waiting' then 'Waiting' when 'interruption -- wait' then 'Waiting'
   when 'interruption -- maintain' then 'Maintenance' when 'well_control -- kick' then 'Well Control'
   when 'well_control -- kill' then 'Well Control' when 'well_control -- shut-in' then 'Well Control'
   when 'interruption -- other' then case
     when regexp_matches(cl, 'cement|woc') then 'Waiting on Cement'
     when regexp_matches(cl, 'mwd|lwd|tool|sensor|probe|signal') then 'MWD/Tool Issue'
     when regexp_matches(cl, 'survey|gyro') then 'Survey Operations'
     when regexp_matches(cl, 'rig up|rig down|rigged|r/u|r/d|nipple') then 'Rig Up/Down'
     when regexp_matches(cl, 'circul|displace|sweep|condition') then 'Circulating/Conditioning'
     when regexp_matches(cl, 'crew|safety|meeting|drill|hse') then 'Crew/Safety/Meeting'
     when regexp_matches(cl, 'slip|cut') then 'Slip & Cut Drill Line'
     when regexp_matches(cl, 'test|fit|lot|leak') then 'Pressure Testing'
     else 'Other NPT (unclassified)' end end as cause,
  case activity_code when 'drilling -- drill' then 'Drilling' when 'drilling -- ream' then 'Reaming'
   when 'drilling -- coring' then 'Coring' when 'cementing -- cement' then 'Cementing' when 'cementing -- casing' then 'Casing'
   when 'completion -- completion' then 'Completion' when 'logging -- log' then 'Logging' end as kind
 from timed0)
"""
BREAKDOWN_SQL = """, s as (select well, {extra}
  sum(case when time_class = 'productive' then hrs else 0 end) as productive_hrs, sum(case when time_class = 'npt' then hrs else 0 end) as npt_hrs,
  sum(case when time_class = 'trip' then hrs else 0 end) as trip_hrs, sum(case when time_class = 'other' then hrs else 0 end) as other_hrs,
  sum(hrs) as total_hrs, cast(count(*) filter (where state = 'problem') as bigint) as problem_count, count(*) as activities
 from timed group by all)
"""
BREAKDOWN = BREAKDOWN_SQL.format(extra="")


def _timed(t):
    return e.timed_activities(t["ddr_activities_timed"])


@query(
    "a6_time_breakdown",
    ["ddr_activities"],
    TIMED
    + BREAKDOWN
    + """select well, round(productive_hrs, 6) as productive_hrs, round(npt_hrs, 6) as npt_hrs, round(trip_hrs, 6) as trip_hrs,
 round(other_hrs, 6) as other_hrs, round(total_hrs, 6) as total_hrs, problem_count, activities,
 round(productive_hrs / total_hrs * 100, 6) as productive_pct, round(npt_hrs / total_hrs * 100, 6) as npt_pct,
 round(trip_hrs / total_hrs * 100, 6) as trip_pct, round(other_hrs / total_hrs * 100, 6) as other_pct from s""",
)
def time_breakdown(t):
    return rounded(e.time_breakdown(_timed(t)))


@query(
    "a7_npt_breakdown",
    ["ddr_activities"],
    TIMED + "select well, cause, round(sum(hrs), 6) as hrs, count(*) as events from timed where time_class = 'npt' group by well, cause",
)
def npt_breakdown(t):
    return rounded(e.npt_breakdown(_timed(t)))


@query(
    "a8_longest_npt_event",
    ["ddr_activities"],
    TIMED
    + """select well, round(hrs, 6) as duration_hrs, date, cause, substr(comments, 1, 120) as comment from (
 select *, row_number() over (partition by well order by hrs desc, date, start_ts, event_id) as r
 from timed where time_class = 'npt' and hrs > 0) where r = 1""",
)
def longest_npt_event(t):
    return rounded(e.longest_npt_event(_timed(t)), 6)


@query(
    "a9_productive_breakdown",
    ["ddr_activities"],
    TIMED + "select well, kind, round(sum(hrs), 6) as hrs, count(*) as events from timed where time_class = 'productive' group by well, kind",
)
def productive_breakdown(t):
    return rounded(e.productive_breakdown(_timed(t)))


@query(
    "n6_duration_hrs",
    ["ddr_activities"],
    TIMED + "select event_id, well, round(hrs, 6) as duration_hrs from timed",
)
def duration(t):
    return rounded(_timed(t).select("event_id", "well", "duration_hrs"), 6)


@query(
    "a10_progress_by_hole",
    ["ddr_status"],
    """, g as (select well, hole_diameter_in, min(md_m) as min_md, max(md_m) as max_md, count(*) as n_days,
  coalesce(nullif(sum(dist_drill_m), 0), max(md_m) - min(md_m)) as drilled_m from ddr_status
  where hole_diameter_in is not null and hole_diameter_in <> 0 and md_m is not null and md_m <> 0 group by well, hole_diameter_in)
select well, hole_diameter_in, round(min_md, 6) as min_md, round(max_md, 6) as max_md, n_days,
 round(drilled_m, 6) as drilled_m, round(drilled_m / n_days, 6) as m_per_day from g""",
)
def progress_by_hole(t):
    return rounded(e.progress_by_hole(t["ddr_status"]), min_md=6, max_md=6)


GAINS = """
, pairs as (select well, date, report_no, md_m, lag(md_m) over (partition by well order by date, report_no) as prev_md from ddr_status),
gains as (select *, md_m - prev_md as gain_m from pairs where md_m <> 0 and prev_md <> 0 and md_m - prev_md > 0)
"""


@query(
    "w4_daily_increment",
    ["ddr_status"],
    GAINS + "select well, date, report_no, round(md_m, 6) as md_m, round(prev_md, 6) as prev_md, round(gain_m, 6) as gain_m from gains",
)
def daily_increment(t):
    return rounded(e.daily_increments(t["ddr_status"]), 6)


@query(
    "a11_daily_progress_stats",
    ["ddr_status"],
    GAINS
    + f""", r as (select well, gain_m, row_number() over (partition by well order by gain_m) as r, count(*) over (partition by well) as n from gains)
select well, round(min(gain_m), 6) as min_gain, round(max(gain_m), 6) as max_gain, {mean_sql('gain_m')} as mean_gain,
 count(*) as n_gains, round(max(case when r = n // 2 + 1 then gain_m end), 6) as median_gain from r group by well""",
)
def daily_progress_stats(t):
    return rounded(e.daily_progress_stats(t["ddr_status"]))


# ------------------------------------------------------------------ phases

PHASES = """
, sized as (select *, lag(hole_diameter_in) over (partition by well order by date, report_no) as prev_hole
  from ddr_status where hole_diameter_in is not null and hole_diameter_in <> 0),
starts as (select * from sized where prev_hole is null or prev_hole <> hole_diameter_in),
ending as (select well, date, md_m from (select *, row_number() over (partition by well order by date desc, report_no desc) as r from ddr_status) where r = 1),
ph as (select s.well, row_number() over w as phase_no, hole_diameter_in,
   case when hole_diameter_in = 36 then 'Conductor (36")' when hole_diameter_in = 26 then 'Surface (26")'
    when hole_diameter_in = 17.5 then 'Intermediate (17.5")' when hole_diameter_in = 12.25 then 'Production (12.25")'
    when hole_diameter_in = 8.5 then 'Reservoir (8.5")' end as section,
   s.date as start_date, coalesce(lead(s.date) over w, e.date) as end_date, s.md_m as start_md,
   coalesce(lead(s.md_m) over w, e.md_m) as end_md
  from starts s join ending e on s.well = e.well window w as (partition by s.well order by s.date, s.report_no))
"""


@query(
    "w1_hole_phases",
    ["ddr_status"],
    PHASES + "select * replace (round(start_md, 6) as start_md, round(end_md, 6) as end_md) from ph",
)
def hole_phases(t):
    return rounded(p.hole_phases(t["ddr_status"]), 6)


_FAMILY = """case when activity_code = 'drilling -- drill' then 'Drilling' when activity_code = 'drilling -- trip' then 'Tripping'
 when activity_code = 'interruption -- other' then 'Other' when activity_code = 'interruption -- waiting on weather' then 'NPT - Weather'
 when activity_code = 'cementing -- casing' then 'Casing' when activity_code = 'well_control -- kick' then 'Well Control'
 when activity_code = 'interruption -- repair' then 'NPT - Repair' else '?' end"""


@query(
    "w2_phase_details",
    ["ddr_status", "ddr_activities_aligned"],
    PHASES
    + f""", rep as (select ph.well, phase_no, count(*) as ddr_days from ph join ddr_status d on d.well = ph.well and d.date between start_date and end_date group by all),
casing as (select well, date, md_m, row_number() over (partition by well, date order by report_no) as r from ddr_status where md_m is not null and md_m <> 0),
ev as (select ph.well, phase_no, summary_24hr, row_number() over (partition by ph.well, phase_no order by date, report_no) as r
  from ph join ddr_status d on d.well = ph.well and d.date between start_date and end_date where summary_24hr <> ''),
act as (select ph.well, phase_no, {_FAMILY} as label, count(*) as n, cast(count(*) filter (where state = 'problem') as bigint) as prob
  from ph join ddr_activities_aligned a on a.well = ph.well and a.date between start_date and end_date group by all),
mix as (select *, row_number() over (partition by well, phase_no order by n desc, label) as r from act),
acts as (select well, phase_no, cast(sum(n) as bigint) as activities, cast(sum(prob) as bigint) as problems,
  string_agg(case when r <= 5 then label || ' ' || cast(n as varchar) end, ', ' order by r) as activity_mix from mix group by well, phase_no)
select ph.well, ph.phase_no, hole_diameter_in, section, start_date, end_date, round(start_md, 6) as start_md, round(end_md, 6) as end_md,
 ddr_days, round(casing.md_m, 6) as casing_point_m, coalesce(activities, 0) as activities, coalesce(problems, 0) as problems,
 coalesce(activity_mix, '') as activity_mix, substr(ev.summary_24hr, 1, 150) as evidence
from ph left join rep on rep.well = ph.well and rep.phase_no = ph.phase_no
 left join casing on casing.well = ph.well and casing.date = end_date and casing.r = 1
 left join acts on acts.well = ph.well and acts.phase_no = ph.phase_no
 left join ev on ev.well = ph.well and ev.phase_no = ph.phase_no and ev.r = 1""",
)
def phase_details(t):
    status = t["ddr_status"]
    return rounded(p.phase_details(p.hole_phases(status), status, t["ddr_activities_aligned"]), 6)


@query(
    "w3_depth_reversals",
    ["ddr_status"],
    """, l as (select *, lag(md_m) over (partition by well order by date, report_no) as from_md from ddr_status where md_m is not null)
select well, date, report_no, round(from_md, 6) as from_md, round(md_m, 6) as to_md, round(from_md - md_m, 6) as drop_m
from l where md_m < from_md - 10""",
)
def depth_reversals(t):
    return rounded(p.depth_reversals(t["ddr_status"]), 6)


@query(
    "a5_phase_distribution",
    ["ddr_activities"],
    f"""select well, {_FAMILY} as phase, count(*) as cnt, round(count(*) * 100.0 / sum(count(*)) over (partition by well), 6) as pct
from ddr_activities group by 1, 2""",
)
def phase_distribution(t):
    return rounded(p.phase_distribution(t["ddr_activities"]), 6)


@query(
    "a26_phase_confidence",
    ["ddr_status", "ddr_activities"],
    PHASES
    + """, a as (select well, count(*) as n from ddr_activities group by well), q as (select well, count(*) as n from ph group by well),
s as (select well, bool_or(coalesce(summary_24hr, '') <> '') as has_summary from ddr_status group by well)
select coalesce(s.well, a.well) as well, coalesce(q.n, 0) as n_phases, coalesce(a.n, 0) as n_activities, coalesce(has_summary, false) as has_summary,
 case when coalesce(a.n, 0) > 20 and has_summary and coalesce(q.n, 0) > 1 then 'HIGH'
  when coalesce(a.n, 0) > 20 and has_summary then 'MEDIUM' else 'LOW' end as confidence
from s full join a on s.well = a.well left join q on q.well = coalesce(s.well, a.well)""",
)
def phase_confidence(t):
    status = t["ddr_status"]
    out = p.phase_confidence(p.hole_phases(status), status, t["ddr_activities"])
    return out.select("well", "n_phases", "n_activities", "has_summary", "confidence")


@query(
    "w5_hole_runs",
    ["ddr_status"],
    """, l as (select *, lag(hole_diameter_in) over w as prev, row_number() over w as rn from ddr_status where md_m is not null
  window w as (partition by well order by date, report_no)),
n as (select *, sum(case when rn = 1 or hole_diameter_in is distinct from prev then 1 else 0 end) over (partition by well order by date, report_no rows unbounded preceding) as run_no from l)
select well, cast(run_no as bigint) as run_no, any_value(hole_diameter_in) as hole_diameter_in, count(*) as n_rows, min(date) as from_date,
 max(date) as to_date, round(min(md_m), 6) as md_min, round(max(md_m), 6) as md_max from n group by well, run_no""",
)
def hole_runs(t):
    return rounded(p.hole_runs(t["ddr_status"]), 6)


@query(
    "r9_depth_time_series",
    ["ddr_status", "ddr_activities"],
    """select well, 'depth' as series, date, round(md_m, 6) as md_m, hole_diameter_in from ddr_status where md_m is not null
union all select well, 'problem', date, round(depth_m, 6), null from ddr_activities where state = 'problem' and depth_m is not null""",
)
def depth_time_series(t):
    return rounded(p.depth_time_series(t["ddr_status"], t["ddr_activities"]), 6)


# -------------------------------------------------------------- comparison

PAIRS = [(f"15_9_F_{i}", f"15_9_F_{i + 1}") for i in range(0, 26, 2)]
PAIR_SQL = ", pairs as (select i // 2 as pair_no, '15_9_F_' || cast(i as varchar) as well_a, '15_9_F_' || cast(i + 1 as varchar) as well_b from range(0, 26, 2) t(i))"


@query(
    "a25_compare_wells",
    ["ddr_status", "ddr_activities", "production"],
    PAIR_SQL
    + """, st as (select well, count(distinct date) as num_reports, min(md_m) as min_depth, max(md_m) as max_depth,
  coalesce(avg(dist_drill_m) filter (where dist_drill_m > 0), 0) as avg_daily_drill, coalesce(max(dist_drill_m) filter (where dist_drill_m > 0), 0) as max_daily_drill
  from ddr_status group by well),
ac as (select well, count(*) filter (where activity_code <> '') as total_activities, count(*) filter (where state = 'problem') as problem_count from ddr_activities group by well),
pr as (select well, sum(bore_oil_vol) as cum_oil, sum(bore_gas_vol) as cum_gas, sum(bore_wat_vol) as cum_water, avg(avg_downhole_pressure) as avg_pressure from production group by well),
m as materialized (select st.*, coalesce(total_activities, 0) as total_activities, coalesce(problem_count, 0) as problem_count, cum_oil, cum_gas, cum_water, avg_pressure
  from st left join ac on ac.well = st.well left join pr on pr.well = st.well),
l as materialized (select well, unnest(['num_reports', 'min_depth', 'max_depth', 'total_activities', 'problem_count', 'avg_daily_drill', 'max_daily_drill', 'cum_oil', 'cum_gas', 'cum_water', 'avg_pressure']) as item,
  unnest([cast(num_reports as double), cast(min_depth as double), cast(max_depth as double), cast(total_activities as double), cast(problem_count as double), cast(avg_daily_drill as double), cast(max_daily_drill as double), cast(cum_oil as double), cast(cum_gas as double), cast(cum_water as double), cast(avg_pressure as double)]) as v from m)
select pair_no, well_a, well_b, a.item, round(a.v, 3) as value_a, round(b.v, 3) as value_b
from pairs join l a on a.well = well_a join l b on b.well = well_b and a.item = b.item""",
)
def compare_wells(t):
    return rounded(c.compare_metrics(t, PAIRS), 3)


@query(
    "j10_compare_activities",
    ["ddr_activities"],
    PAIR_SQL
    + """, d as (select well, activity_code, count(*) as cnt, count(*) * 100.0 / sum(count(*)) over (partition by well) as pct
  from ddr_activities where activity_code <> '' group by well, activity_code),
a as (select pair_no, well_a, well_b, activity_code, cnt, pct from pairs join d on well = well_a),
b as (select pair_no, well_a, well_b, activity_code, cnt, pct from pairs join d on well = well_b)
select coalesce(a.pair_no, b.pair_no) as pair_no, coalesce(a.well_a, b.well_a) as well_a, coalesce(a.well_b, b.well_b) as well_b,
 coalesce(a.activity_code, b.activity_code) as activity_code, coalesce(a.cnt, 0) as cnt_a, coalesce(b.cnt, 0) as cnt_b,
 round(coalesce(a.pct, 0), 6) as pct_a, round(coalesce(b.pct, 0), 6) as pct_b
from a full join b on a.pair_no = b.pair_no and a.activity_code = b.activity_code""",
)
def compare_activities(t):
    return rounded(c.compare_activities(t, PAIRS), 6)
