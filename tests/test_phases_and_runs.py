"""Phases and assembly runs against plain loops: shared edges, repeats, single rows."""

import datetime as dt
import random

from strataflow.operators import phases, questions


def test_runs_that_share_edges_repeat_or_hold_nothing(spark):
    rng = random.Random(5)
    logs = [("w", float(d), d + 1.0, rng.choice([None, 10.0, 20.5]) or 5.0, rng.choice([None, 3.0])) for d in range(0, 200)]
    runs = [("w", n, a, a + rng.choice([0.0, 0.5, 7.0, 60.0])) for n, a in enumerate([0.0, 0.5, 0.5, 10.0, 10.0, 150.5, 500.0])]
    runs += [runs[1], runs[1], ("w", None, 0.0, 20.0), ("v", 1, 0.0, 9.0), ("w", 99, 9.0, 3.0)]
    mudlog = spark.createDataFrame(logs, "well string, md_top_m double, md_bottom_m double, rop_avg_m_per_hr double, wob_avg_kN double")
    mudlog = mudlog.selectExpr("*", "cast(null as double) as rpm_avg", "cast(null as double) as torque_avg_kNm")
    table = spark.createDataFrame(runs, "well string, run_no long, md_start_m double, md_stop_m double")
    got = sorted((tuple(r) for r in questions.run_performance(table, mudlog).collect()), key=str)
    want = []
    for well, n, a, b in runs:
        if a > b:
            continue
        inside = [x for x in logs if well == x[0] and a <= (x[1] + x[2]) / 2 <= b]
        wob = [x[4] for x in inside if x[4] is not None]
        rop = sum(x[3] for x in inside) / len(inside) if inside else None
        want.append((well, n, a, b, len(inside), rop, sum(wob) / len(wob) if wob else None))
    assert got == sorted(want, key=str)


def test_phases_of_single_rows_and_of_a_change_on_the_last_row(spark):
    def day(n):
        return dt.date(2020, 1, n)

    rows = [
        ("one", day(1), 1, 10.0, 17.5),
        ("none", day(1), 2, 10.0, None), ("none", day(2), 3, 20.0, 0.0),
        ("two", day(1), 4, 10.0, None), ("two", day(2), 5, 20.0, 26.0), ("two", day(3), 6, 30.0, None),
        ("two", day(3), 7, 40.0, 26.0), ("two", day(5), 8, 50.0, 12.25),
    ]
    status = spark.createDataFrame(rows, "well string, date date, report_no long, md_m double, hole_diameter_in double")
    found = phases.hole_phases(status).select("well", "phase_no", "hole_diameter_in", "start_date", "end_date", "start_md", "end_md")
    assert sorted(tuple(r) for r in found.collect()) == [
        ("one", 1, 17.5, day(1), day(1), 10.0, 10.0),
        ("two", 1, 26.0, day(2), day(5), 20.0, 50.0),
        ("two", 2, 12.25, day(5), day(5), 50.0, 50.0),
    ]
    texts = status.selectExpr("*", "concat('day ', report_no) as summary_24hr")
    work = spark.createDataFrame([("two", day(2), "drilling -- drill", "ok"), ("two", day(4), "x", "problem")], "well string, date date, activity_code string, state string")
    details = phases.phase_details(phases.hole_phases(status), texts, work).select("well", "phase_no", "ddr_days", "casing_point_m", "activities", "problems", "evidence")
    assert sorted(tuple(r) for r in details.collect()) == [
        ("one", 1, 1, 10.0, 0, 0, "day 1"),
        ("two", 1, 4, 50.0, 2, 1, "day 5"),
        ("two", 2, 1, 50.0, 0, 0, "day 8"),
    ]
