"""Ordered scans and depth joins against brute force, with a key that owns most rows."""

import random

import pytest
from pyspark.sql import functions as F

from strataflow.operators import intervals, ordered
from strataflow.operators.questions import rank_wells


def skewed(seed, n=400):
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(60), i, rng.choice([None, 1.0, 2.0, 3.5]))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_scan(spark, seed):
    rows = skewed(seed)
    df = spark.createDataFrame(rows, "k string, day int, id long, v double")
    out = ordered.scan(
        df,
        ["k"],
        ordered.Cut(lambda c: F.floor(c / 3), whole=1),
        ["day", "id"],
        lag={"prev": F.col("v")},
        lead={"next": F.col("v")},
        last_known={"before": F.col("v")},
        next_known={"after": F.col("v")},
        total={"upto": F.lit(1)},
    ).collect()
    assert len(out) == len(rows)
    got = {r.id: r for r in out}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, row in enumerate(own):
            r = got[row[2]]
            assert r.prev == (own[i - 1][3] if i else None)
            assert r.next == (own[i + 1][3] if i + 1 < len(own) else None)
            assert r.before == next((o[3] for o in reversed(own[:i]) if o[3] is not None), None)
            assert r.after == next((o[3] for o in own[i + 1 :] if o[3] is not None), None)
            assert r.upto == i + 1


def test_scan_with_ids_that_do_not_rise_with_time(spark):
    """Chunks of three rows at most, ids around a block border, a NULL key."""
    rng = random.Random(5)
    rows = [(k, t, rng.choice([0, ordered.ID_BLOCK, 5 * ordered.ID_BLOCK]) + i) for k in ("a", None) for i, t in enumerate(rng.sample(range(60), 40))]
    df = spark.createDataFrame(rows, "k string, t int, id long").withColumn("ts", F.timestamp_seconds(F.col("t") * 600))
    for cut in (ordered.BY_HOUR, ordered.Cut(lambda c: F.date_trunc("minute", c))):
        out = ordered.scan(df, ["k"], cut, ["ts", "id"], lead={"next": F.col("t")}, total={"upto": F.lit(1)}).collect()
        for key in ("a", None):
            own = sorted((r for r in out if r.k == key), key=lambda r: (r.t, r.id))
            assert [r.next for r in own] == [r.t for r in own[1:]] + [None]
            assert [r.upto for r in own] == list(range(1, 41))


def test_an_outlier_leaves_values_spread(spark):
    df = spark.createDataFrame([("a", float(i) / 100) for i in range(5000)] + [("a", 1e9), ("a", 0.0), ("a", -3.0)], "k string, v double")
    sizes = [r["count"] for r in df.groupBy(ordered.value_range(F.col("v")).alias("r")).count().collect()]
    assert len(sizes) > 500 and max(sizes) < 50
    order = [r.r for r in df.withColumn("r", ordered.value_range(F.col("v"))).orderBy("v").collect()]
    assert order == sorted(order)


@pytest.mark.parametrize("seed", [1, 3])
def test_upper_median(spark, seed):
    rng = random.Random(seed)
    data = {"a": [rng.randrange(50) / 4 for _ in range(301)], "b": [1.0, 2.0, 3.0, 4.0], "c": [7.0], "d": [5.0] * 9, "e": [-1e9, -2.0, 0.0, 1e9]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r.k: r.median for r in ordered.upper_median(df, ["k"], "v").collect()}
    assert got == {k: sorted(v)[len(v) // 2] for k, v in data.items()}


def test_depth_joins(spark):
    rng = random.Random(7)
    tops = [(rng.choice("ab"), float(rng.randrange(0, 200)), i, f"t{i}") for i in range(60)]
    probes = [(rng.choice("abc"), rng.choice([None, 0.0, *[x / 2 for x in range(0, 420)]]), i) for i in range(300)]
    left = spark.createDataFrame(probes, "w string, d double, id int")
    right = spark.createDataFrame(tops, "w string, md double, no int, name string")
    args = (left, right, ["w"], "d", "md", ["name"], [F.col("no")])
    asof = {r.id: r.name for r in intervals.asof_join(*args).collect()}
    near = {r.id: r.name for r in intervals.nearest_join(*args).collect()}
    assert len(asof) == len(near) == len(probes)
    for w, d, i in probes:
        own = [t for t in tops if t[0] == w]
        above = max((t for t in own if d and t[1] <= d), key=lambda t: (t[1], t[2]), default=None)
        assert asof[i] == (above and above[3])
        close = min(own, key=lambda t: (abs(t[1] - d), t[1], -t[2]), default=None) if d is not None else None
        assert near[i] == (close and close[3])


def test_interval_mean(spark):
    rng = random.Random(3)
    spans = []
    for i in range(150):
        lo = float(rng.randrange(0, 300))
        spans.append((rng.choice("ab"), lo, rng.choice([lo + rng.randrange(0, 25), lo - 3, None, 0.0]), rng.randrange(1, 4000) / 8, i))
    probes = [(rng.choice("abc"), float(rng.randrange(1, 700)) / 2, i) for i in range(250)]
    left = spark.createDataFrame(probes, "w string, d double, id int")
    right = spark.createDataFrame(spans, "w string, lo double, hi double, v double, id int")
    out = intervals.interval_mean(left, right, ["w"], "d", "lo", "hi", "v")
    got = {(r.w, r.d): (r.n_containing, r.v_at) for r in out.collect()}
    assert len(got) == len({p[:2] for p in probes})
    for (w, d), (n, value) in got.items():
        own = [s for s in spans if s[0] == w]
        inside = [s[3] for s in own if s[1] and s[2] and s[1] <= d <= s[2]]
        assert n == len(inside)
        if inside:
            assert value == pytest.approx(sum(inside) / n)
        elif own:
            best = min(own, key=lambda s: (abs((s[1] + (s[2] or 0)) / 2 - d), s[1], s[3]))
            assert value == pytest.approx(best[3])
        else:
            assert value is None


def test_assign_to_window(spark):
    windows = [("a", 8.5, 100.0, 300.0), ("a", 12.25, 50.0, 250.0), ("a", 26.0, 0.0, 60.0), ("b", 8.5, None, 5.0)]
    rows = [("a", 55.0), ("a", 120.0), ("a", 290.0), ("a", 400.0), ("b", 3.0), ("a", 60.0)]
    df = spark.createDataFrame(rows, "w string, p double")
    win = spark.createDataFrame(windows, "w string, hole double, lo double, hi double")
    out = intervals.assign_to_window(df, win, ["w"], F.col("p"), "lo", "hi", "hole")
    assert sorted((r.w, r.p, r.hole) for r in out.collect()) == [
        ("a", 55.0, 26.0), ("a", 60.0, 26.0), ("a", 120.0, 12.25), ("a", 290.0, 8.5),
    ]


def test_rank_wells(spark):
    rows = [("a", 3.0), ("b", None), ("c", 9.0), ("d", 3.0), ("e", -1.0)]
    ranked = rank_wells(spark.createDataFrame(rows, "well string, v double"), "v", "r")
    assert {r.well: r.r for r in ranked.collect()} == {"c": 1, "a": 2, "d": 3, "e": 4, "b": 5}
