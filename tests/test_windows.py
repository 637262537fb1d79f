"""Windows of depth: the narrowest that holds a row, whatever their number."""

import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from strataflow.operators.intervals import assign_to_window, spans_of_slots


def winner(windows, well, x):
    held = [(hi - lo, -label, lo, hi, label) for w, label, lo, hi in windows if w == well and lo is not None and hi is not None and lo <= x <= hi]
    return min(held)[-1] if held else None


def assigned(spark, rows, windows, **more):
    df = spark.createDataFrame(rows, "id long, well string, md double").repartition(4)
    cut = spark.createDataFrame(windows, "well string, size double, lo double, hi double").repartition(4)
    return assign_to_window(df, cut, ["well"], F.col("md"), "lo", "hi", "size", **more)


@pytest.mark.parametrize("seed", range(3))
def test_against_loops(spark, seed):
    rng = random.Random(seed)
    windows = []
    for well in ("a", "b", "c"):
        for k in range({"a": 1, "b": 5, "c": 60}[well]):
            lo = rng.choice([rng.uniform(0, 300), rng.randrange(0, 300)])
            windows.append((well, float(rng.randrange(1, 9) * 100 + k), float(lo), float(lo) + rng.choice([0.0, 1.0, rng.randrange(0, 90), rng.uniform(0, 300)])))
    windows += [("a", 1.0, None, 5.0), ("b", 2.0, 7.0, None), ("c", 3.0, 50.0, 40.0)]
    rows = [(i, rng.choice("abcd"), rng.choice([None, float(rng.randrange(0, 400)), rng.uniform(0, 400)])) for i in range(800)]
    rows += [(1000 + i, w, edge) for i, (w, _, lo, hi) in enumerate(windows) for edge in (lo, hi)]
    got = {(r.id, r.md): (r["size"], r.lo, r.hi) for r in assigned(spark, rows, windows, extra=["lo", "hi"]).collect()}
    want = {(i, x): winner(windows, w, x) for i, w, x in rows if x is not None}
    assert {k: v[0] for k, v in got.items()} == {k: v for k, v in want.items() if v is not None}
    assert all(lo <= x <= hi for (_, x), (_, lo, hi) in got.items())


def test_a_well_with_100_000_windows(spark):
    """Nested and chained windows of one well, far more than an array per well should hold."""
    n = 100_000
    windows = spark.range(n).select(
        F.lit("w").alias("well"), F.col("id").cast("double").alias("size"),
        (F.col("id") / 50).alias("lo"), (F.col("id") / 50 + F.when(F.col("id") % 2 == 0, 0.5).otherwise(40.0)).alias("hi"),
    )
    rows = spark.range(5_000).select(F.lit("w").alias("well"), "id", (F.col("id") * 0.401 + 0.0101).alias("md"))
    got = {r.id: r["size"] for r in assign_to_window(rows, windows, ["well"], F.col("md"), "lo", "hi", "size").collect()}
    lows = [i / 50 for i in range(n)]
    for i in range(5_000):
        x = i * 0.401 + 0.0101
        last = bisect_right(lows, x) - 1
        best = min((hi - k / 50, -k) for k in range(max(0, last - 2_001), last + 1) for hi in [k / 50 + (0.5 if k % 2 == 0 else 40.0)] if x <= hi)
        assert got[i] == -best[1]


def test_no_rows_and_no_windows(spark):
    rows, windows = [(1, "a", 5.0)], [("a", 8.5, 1.0, 9.0)]
    assert assigned(spark, rows, windows).count() == 1
    assert assigned(spark, rows, windows).limit(0).count() == 0
    empty = spark.createDataFrame(windows, "well string, size double, lo double, hi double").limit(0)
    df = spark.createDataFrame(rows, "id long, well string, md double")
    assert assign_to_window(df, empty, ["well"], F.col("md"), "lo", "hi", "size").count() == 0


def test_no_array_of_windows(spark):
    plan = assigned(spark, [(1, "a", 5.0)], [("a", 8.5, 1.0, 9.0)])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


def test_covers_of_slots(spark):
    rng = random.Random(5)
    spans = [(a, a + rng.randrange(0, 70)) for a in [0, 1, 2, 3, *(rng.randrange(0, 100) for _ in range(60))]]
    df = spark.createDataFrame(spans, "a long, b long").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(8))))
    got = df.select("a", "b", "level", F.explode(spans_of_slots(F.col("a"), F.col("b"), F.col("level"))).alias("block")).distinct().collect()
    for a, b in set(spans):
        held = sorted(s for r in got if (r.a, r.b) == (a, b) for s in range(r.block << r.level, (r.block + 1) << r.level))
        assert held == list(range(a, b + 1))
