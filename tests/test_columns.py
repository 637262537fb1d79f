"""Column functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from strataflow.functions import activity, names, numbers, text


def values(spark, column, inputs, kind="string"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_normalize(spark):
    pairs = {
        "15_9_F_11_T2": "15_9_F_11_T2",
        "NO 15/9-F-11 T2": "15_9_F_11_T2",
        "15/9-F-11": "15_9_F_11",
        "15/9-F-1 C": "15_9_F_1_C",
        "NO 15/9-19 A": "15_9_19_A",
        "15/9--F-11": "15_9_F_11",
        "  NO 15/9-F-11  ": "15_9_F_11",
        "NORTH 1": "NORTH_1",
    }
    assert values(spark, names.normalize_well_name, pairs) == list(pairs.values())


def test_display(spark):
    pairs = {
        "15_9_F_11_T2": "15/9-F-11 T2",
        "15_9_F_11": "15/9-F-11",
        "15_9_F_1_C": "15/9-F-1 C",
        "15_9_19_A": "15/9-19 A",
        "15_9_19_BT2": "15/9-19 BT2",
        "15_9_F": "15/9-F-",
        "AB": "AB",
        "A_B": "A_B",
    }
    assert values(spark, names.display_well_name, pairs) == list(pairs.values())


@pytest.mark.parametrize(
    "raw, shown",
    [
        ("NO 15/9-F-11 T2", "15/9-F-11 T2"),
        ("NO 15/9-F-1 C", "15/9-F-1 C"),
        ("15/9-F-11", "15/9-F-11"),
        ("NO 15/9-19 A", "15/9-19 A"),
    ],
)
def test_round_trip(spark, raw, shown):
    assert values(spark, lambda c: names.display_well_name(names.normalize_well_name(c)), [raw]) == [shown]


def test_parent_and_pattern(spark):
    wells = ["15_9_F_11_T2", "15_9_F_11", "15_9_F_1_A_B"]
    assert values(spark, names.parent_well, wells) == ["15_9_F_11", None, "15_9_F_1"]
    assert values(spark, lambda c: names.well_matches(c, "15_9_F_11*"), wells) == [True, True, False]
    assert values(spark, lambda c: names.well_matches(c, "15_9_F_11"), ["15_9_F_11", "1539_F_11"]) == [True, False]


def test_missing_value_rules(spark):
    raw = ["-999.99", "-999.25", "-9999", "-990", "x", "", " 3.5 ", "1e3", None, "nan"]
    assert values(spark, numbers.clean_float_ddr, raw) == [None, None, None, -990.0, None, None, 3.5, 1000.0, None, None]
    assert values(spark, numbers.clean_float_witsml, raw) == [-999.99, None, None, -990.0, None, None, 3.5, 1000.0, None, None]
    assert values(spark, numbers.to_int, ["3.7", "12", "-2.9", "x", ""]) == [3, 12, -2, None, None]


def test_unit_constants():
    assert abs(numbers.RAD_TO_DEG - 57.2957795) < 0.001
    assert numbers.MPS_TO_MPH == 3600.0


def test_hole_section_names(spark):
    sizes = [36.0, 30.0, 26.0, 17.5, 12.25, 8.5, 10.375, 10.25, 6.0, 28.0, 34.0, 9.875, None]
    assert values(spark, numbers.hole_section_name, sizes, "double") == [
        'Conductor (36")', 'Conductor (30")', 'Surface (26")', 'Intermediate (17.5")', 'Production (12.25")',
        'Reservoir (8.5")', 'Production (12.25")', 'Reservoir (8.5")', '6.0" Section', '28.0" Section', '34.0" Section',
        'Reservoir (8.5")', "Unknown",
    ]


@pytest.mark.parametrize(
    "start, end, hours",
    [
        ("2013-03-24T00:00:00+01:00", "2013-03-24T01:30:00+01:00", 1.5),
        ("2013-03-24T00:00:00", "2013-03-24T01:30:00", 1.5),
        ("2013-03-24T00:00:00Z", "2013-03-24T01:00:00+01:00", 0.0),
        ("2013-03-24T00:00:00", "2013-03-24T01:30:00+01:00", 0.0),
        ("2013-03-24T02:00:00", "2013-03-24T01:00:00", -1.0),
        ("", "2013-03-24T01:00:00", 0.0),
        ("soon", "2013-03-24T01:00:00", 0.0),
        (None, None, 0.0),
        ("2013-03-24", "2013-03-25", 24.0),
    ],
)
def test_iso_duration(spark, start, end, hours):
    df = spark.createDataFrame([(start, end)], "s string, e string")
    assert df.select(numbers.iso_duration_hrs(F.col("s"), F.col("e"))).first()[0] == pytest.approx(hours)


def test_blank_codes(spark):
    assert values(spark, activity.classify_phase, [None, "", "  ", "Drilling -- Drill "]) == ["Unknown", "Unknown", "Other", "Drilling"]
    assert values(spark, activity.classify_time, [None, "trip"]) == ["other", "trip"]


def test_issue_precedence(spark):
    rows = [
        ("interruption -- repair", "equipment failure", "kick seen", "Well Control"),
        ("interruption -- repair", "equipment failure", "", "Equipment Repair"),
        ("INTERRUPTION -- REPAIR", "", "", "Other Issue"),
        ("INTERRUPTION -- MAINTAIN", "", "", "Equipment Repair"),
        ("interruption -- waiting on weather", "", "", "Weather Delay"),
        ("interruption -- waiting", "", "stuck", "Waiting/Delay"),
        ("x", "mud loss", "", "Mud Losses"),
        ("x", "", "loss of circulation", "Mud Losses"),
        ("x", "", "loss of time, stuck", "Stuck Pipe"),
        ("x", "operation failed", "flow check", "Flow Check"),
        (None, "operation failed", None, "Operational Difficulty"),
    ]
    df = spark.createDataFrame(rows, "c string, d string, m string, want string")
    got = df.select(activity.issue_category(F.col("c"), F.col("d"), F.col("m")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_answer_parts(spark):
    good = "\n".join(f"## {s}" for s in text.ANSWER_SECTIONS)
    assert values(spark, text.missing_sections, [good, "# answer"]) == [[], list(text.ANSWER_SECTIONS[1:])]
    assert values(spark, text.has_measurement, ["12.5 m/hr", "12 kN", "twelve", "5 %"]) == [True, True, False, True]
    quotes = ["DDR 15/9-F-1, 2013", "daily report 2013-04-22", '"Drilled ahead"', "ddr\n15/9 2013", "none"]
    assert values(spark, text.has_dated_quote, quotes) == [True, True, True, False, False]
    assert values(spark, text.extract_confidence, ["so Medium it is", "none", None]) == ["MEDIUM", "N/A", "N/A"]
