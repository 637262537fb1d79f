"""Depth joins without pairs: as-of, neighbours, nearest, interval mean, windows.

A lookup depends on (key, depth) only, so equal probe depths are merged first.  Distinct probes and
points are then scanned together in depth order (see ``ordered``), and the answer is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import interval_mid, truthy
from .ordered import by_depth, scan, union_all

# A well has as many chunks as metres; even of 10**10 distinct depths one chunk holds a few million.
DEPTH_BIN_M = 1.0
POINT, KNOWN, PROBE, CLOSE = 0, 1, 2, 3


def distinct_points(
    points: DataFrame,
    by: Sequence[str],
    position: Column,
    payload: Sequence[str],
    tie: Sequence[Column],
    keep: str = "last",
) -> DataFrame:
    """One row per (key, position): the payload of the last (or first) row in tie order."""
    pick = F.max_by if keep == "last" else F.min_by
    order = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(tie)])
    return (
        points.withColumn("_pos", position)
        .filter(F.col("_pos").isNotNull())
        .groupBy(*by, "_pos")
        .agg(pick(F.struct(F.col("_pos").alias("pos"), *payload), order).alias("_point"))
    )


def distinct_probes(probes: DataFrame, by: Sequence[str], position: str) -> DataFrame:
    return (
        probes.filter(F.col(position).isNotNull())
        .select(*by, F.col(position).alias("_pos"))
        .distinct()
    )


def around(
    probes: DataFrame,
    points: DataFrame,
    by: Sequence[str],
    width: float = DEPTH_BIN_M,
    before: bool = True,
    after: bool = False,
) -> DataFrame:
    """For distinct probes: ``before`` = last point at or above, ``after`` = first point below."""
    merged = union_all(
        [
            points.withColumn("_kind", F.lit(POINT)),
            probes.withColumn("_kind", F.lit(PROBE)),
        ]
    )
    scanned = scan(
        merged,
        by,
        by_depth(width),
        ["_pos", "_kind"],
        last_known={"before": F.col("_point")} if before else None,
        next_known={"after": F.col("_point")} if after else None,
    )
    return scanned.filter(F.col("_kind") == PROBE).drop("_kind", "_point")


def asof_join(
    probes: DataFrame,
    points: DataFrame,
    by: Sequence[str],
    probe_position: str,
    point_position: str,
    payload: Sequence[str],
    tie: Sequence[Column],
    width: float = DEPTH_BIN_M,
) -> DataFrame:
    """Every probe row with the payload of the last point at or above its depth.

    A NULL or zero depth finds nothing.
    """
    usable = probes.filter(truthy(F.col(probe_position)))
    found = around(
        distinct_probes(usable, by, probe_position),
        distinct_points(points, by, F.col(point_position), payload, tie),
        by,
        width,
    ).select(*by, F.col("_pos").alias(probe_position), *[F.col(f"before.{c}").alias(c) for c in payload])
    return probes.join(found, [*by, probe_position], "left")


def asof_neighbors(
    probes: DataFrame,
    tops: DataFrame,
    by: Sequence[str],
    probe_position: str,
    name: str,
    position: str,
    tie: str,
    width: float = DEPTH_BIN_M,
) -> DataFrame:
    """Current breakpoint at a depth, the row before it in depth order, and the first one below."""
    ordered = scan(
        tops.filter(F.col(position).isNotNull()),
        by,
        by_depth(width),
        [position, tie],
        lag={"_above": F.struct(F.col(name).alias("name"), F.col(position).alias("pos"))},
    ).withColumns(
        {"above_name": F.col("_above.name"), "above_m": F.col("_above.pos")}
    )
    payload = [name, "above_name", "above_m"]
    current = distinct_points(ordered, by, F.col(position), payload, [F.col(tie)])
    upcoming = distinct_points(tops, by, F.col(position), [name], [F.col(tie)], keep="first")
    both = current.join(upcoming.withColumnRenamed("_point", "_first"), [*by, "_pos"]).withColumn(
        "_point", F.struct(F.col("_point").alias("current"), F.col("_first").alias("first"))
    )
    found = around(
        distinct_probes(probes, by, probe_position), both.drop("_first"), by, width, after=True
    ).select(
        *by,
        F.col("_pos").alias(probe_position),
        F.col(f"before.current.{name}").alias("current_name"),
        F.col("before.current.pos").alias("current_m"),
        F.col("before.current.above_name").alias("above_name"),
        F.col("before.current.above_m").alias("above_m"),
        F.col(f"after.first.{name}").alias("below_name"),
        F.col("after.first.pos").alias("below_m"),
    )
    return probes.join(found, [*by, probe_position], "left")


def nearest_point() -> Column:
    """The closer of ``before`` and ``after``; the shallower one when both are as close."""
    up = F.col("_pos") - F.col("before.pos")
    down = F.col("after.pos") - F.col("_pos")
    use_before = F.col("after").isNull() | (up <= down)
    return F.when(F.coalesce(use_before, F.lit(False)), F.col("before")).otherwise(F.col("after"))


def nearest_join(
    probes: DataFrame,
    points: DataFrame,
    by: Sequence[str],
    probe_position: str,
    point_position: str,
    payload: Sequence[str],
    tie: Sequence[Column],
    width: float = DEPTH_BIN_M,
) -> DataFrame:
    """Every probe row with the payload of the nearest point in either direction."""
    found = around(
        distinct_probes(probes, by, probe_position),
        distinct_points(points, by, F.col(point_position), payload, tie),
        by,
        width,
        after=True,
    ).withColumn("_near", nearest_point())
    answer = found.select(
        *by,
        F.col("_pos").alias(probe_position),
        *[F.col(f"_near.{c}").alias(c) for c in payload],
        F.abs(F.col("_near.pos") - F.col("_pos")).alias("nearest_gap"),
    )
    return probes.join(answer, [*by, probe_position], "left")


def interval_sweep(
    probes: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    lo: str,
    hi: str,
    value: str,
    width: float = DEPTH_BIN_M,
    points: DataFrame | None = None,
    also: Sequence[str] = (),
) -> DataFrame:
    """``probes`` with ``n_containing`` and ``mean`` of ``value``, and ``known``, answered in one order.

    Probes have the key, ``_pos`` and the columns ``also``, which tell equal depths apart.  An interval adds
    its value where it opens and takes it back where it closes; where none holds a depth, the nearest
    midpoint answers.  ``points`` (key, ``_pos``, ``_payload``, ``_tie``) give ``known``, the payload of the
    last point at or above a depth.  Sums are fixed-point decimals, so nothing is lost when they cancel.
    An edge that is NULL or zero, or edges in the wrong order, hold no depth; their midpoint still
    counts.  Midpoint ties go to the smaller ``lo``, then to the smaller value.
    """
    fixed = "decimal(38,9)"
    holds = truthy(F.col(lo)) & truthy(F.col(hi)) & (F.col(lo) <= F.col(hi))
    mid = interval_mid(F.col(lo), F.col(hi))
    point = F.struct(
        mid.alias("pos"),
        F.coalesce(lo, F.lit(float("inf"))).alias("lo"),
        F.col(value).alias("value"),
    )

    def edge(position: str, kind: int, sign: int) -> Column:
        v = (sign * F.col(value)).cast("decimal(20,9)")
        return F.struct(F.col(position).alias("_pos"), F.lit(kind).alias("_kind"), F.lit(sign).cast("long").alias("_n"), v.alias("_v"))

    # Sums and midpoints apart: sums need no sorted aggregation, and they are two rows of three.
    edges = (
        intervals.filter(holds)
        .select(*by, F.inline(F.array(edge(lo, POINT, 1), edge(hi, CLOSE, -1))))
        .groupBy(*by, "_pos", "_kind")
        .agg(F.sum("_n").alias("_n"), F.sum("_v").cast(fixed).alias("_v"))
    )
    known = intervals.select(*by, mid.alias("_pos"), point.alias("_point"))
    if points is not None:
        known = union_all([known, points])
    known = known.filter(F.col("_pos").isNotNull()).groupBy(*by, "_pos").agg(
        F.min("_point").alias("_point"), *([] if points is None else [F.max_by("_payload", "_tie").alias("_payload")])
    )
    events = union_all([edges, known.withColumn("_kind", F.lit(KNOWN))])
    swept = scan(
        union_all([events, probes.withColumn("_kind", F.lit(PROBE))]),
        by,
        by_depth(width),
        ["_pos", "_kind", *also],
        last_known={"before": F.col("_point")} | ({} if points is None else {"known": F.col("_payload")}),
        next_known={"after": F.col("_point")},
        total={
            "n_containing": F.coalesce(F.col("_n"), F.lit(0)),
            "_sum": F.coalesce(F.col("_v"), F.lit(0).cast(fixed)),
        },
    ).filter(F.col("_kind") == PROBE)
    up = F.col("_pos") - F.col("before.pos")
    down = F.col("after.pos") - F.col("_pos")
    nearest = (
        F.when(F.col("after").isNull() | (up < down), F.col("before.value"))
        .when(F.col("before").isNull() | (up > down), F.col("after.value"))
        .when(F.col("before.lo") <= F.col("after.lo"), F.col("before.value"))
        .otherwise(F.col("after.value"))
    )
    mean = F.when(F.col("n_containing") > 0, F.col("_sum").cast("double") / F.col("n_containing")).otherwise(nearest)
    return swept.select(*probes.columns, "n_containing", mean.alias("mean"), *([] if points is None else ["known"]))


def interval_mean(
    probes: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    probe_position: str,
    lo: str,
    hi: str,
    value: str,
    width: float = DEPTH_BIN_M,
) -> DataFrame:
    """Mean ``value`` of the intervals that hold a depth, else that of the nearest midpoint.

    Returns distinct probes with ``n_containing`` and the mean; see ``interval_sweep``.
    """
    swept = interval_sweep(distinct_probes(probes, by, probe_position), intervals, by, lo, hi, value, width)
    return swept.select(*by, F.col("_pos").alias(probe_position), "n_containing", F.col("mean").alias(f"{value}_at"))


def spans_of_slots(first: Column, last: Column, level: Column) -> Column:
    """The blocks of 2**level slots that belong to the cover of slots ``first``..``last`` at that level.

    Block b of a level holds the slots of blocks 2b and 2b+1 below; a cover has at most two blocks a level.
    """
    one = F.lit(1).cast("long")
    size = F.call_function("shiftleft", one, level)
    lo = F.call_function("shiftright", first + size - 1, level)
    hi = F.call_function("shiftright", last + 1, level)
    odd = (lo < hi) & (lo % 2 == 1), (lo < hi) & (hi % 2 == 1)
    # A block that is both the first and the last is taken once.
    return F.array_distinct(F.array_compact(F.array(F.when(odd[0], lo), F.when(odd[1], hi - 1))))


def elementary_winners(windows: DataFrame, by: Sequence[str], lo: str, hi: str, best: Column) -> DataFrame:
    """Windows cut at their edges: ``_pos`` of each edge, the winner ``at`` it and ``after`` it up to the next.

    The winner of overlapping windows is the one of smallest ``best``.  Edges are numbered in
    depth order; edge i is slot 2i, the gap behind it slot 2i+1.  A window covers a run of slots, which is
    two blocks a level at most; a slot's winner is the best over the blocks that hold it.  The edges of a key
    are sorted, not held, and overlapping windows cost a logarithm, not a product.
    """
    edge = F.explode(F.array(F.struct(F.col(lo).alias("pos")), F.struct(F.col(hi).alias("pos"))))
    cut = windows.filter(F.col(lo) <= F.col(hi)).select(*by, best.alias("_best"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), edge.alias("_e"))
    numbers = Window.partitionBy(*by).orderBy("_e.pos")
    numbered = cut.withColumn("_slot", (F.dense_rank().over(numbers).cast("long") - 1) * 2)

    placed = numbered.groupBy(*by, "_lo", "_hi", "_best").agg(F.min("_slot").alias("_first"), F.max("_slot").alias("_last"))
    levels = F.floor(F.log2(F.col("_last") - F.col("_first") + 1)).cast("int")
    blocks = (
        placed.withColumn("_level", F.explode(F.sequence(F.lit(0), levels)))
        .withColumn("_block", F.explode(spans_of_slots(F.col("_first"), F.col("_last"), F.col("_level"))))
        .groupBy(*by, "_level", "_block")
        .agg(F.min("_best").alias("_best"))
    )
    # Every slot asks its block on each level that the key can have.
    highest = F.floor(F.log2(F.max("_slot").over(Window.partitionBy(*by)) + 1)).cast("int")
    asked = (
        numbered.groupBy(*by, F.col("_e.pos").alias("_pos")).agg(F.min("_slot").alias("_slot"))
        .withColumn("_highest", highest)
        .withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_highest"))))
        .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_block", F.call_function("shiftright", F.col("_slot") + F.col("_side"), F.col("_level")))
    )
    won = asked.join(blocks, [*by, "_level", "_block"])
    return won.groupBy(*by, "_pos").agg(
        F.min(F.when(F.col("_side") == 0, F.col("_best"))).alias("at"), F.min(F.when(F.col("_side") == 1, F.col("_best"))).alias("after")
    )


def assign_to_window(
    rows: DataFrame,
    windows: DataFrame,
    by: Sequence[str],
    position: Column,
    lo: str,
    hi: str,
    label: str,
    extra: Sequence[str] = (),
    width: float = DEPTH_BIN_M,
) -> DataFrame:
    """Each row with the narrowest window of its key that holds it; the larger label on ties.

    Windows may be any number: they are cut into elementary intervals, and a row takes the winner of the
    interval its depth lies in, found as of the last edge above.  Rows in no window are dropped.
    """
    kept = [c for c in (label, *extra) if c not in (lo, hi)]
    best = F.struct((F.col(hi) - F.col(lo)).alias("_width"), (-F.col(label)).alias("_rank"), F.col(lo), F.col(hi), *kept)
    cut = elementary_winners(windows, by, lo, hi, best)
    located = rows.withColumn("_pos", position).filter(F.col("_pos").isNotNull())
    points = cut.select(*by, "_pos", F.struct(F.col("_pos").alias("pos"), "at", "after").alias("_point"))
    found = around(located.select(*by, "_pos").distinct(), points, by, width)
    hit = F.when(F.col("before.pos") == F.col("_pos"), F.col("before.at")).otherwise(F.col("before.after"))
    found = found.select(*by, "_pos", hit.alias("_hit")).filter(F.col("_hit").isNotNull())
    names = dict.fromkeys([label, *extra])
    return located.join(found, [*by, "_pos"]).withColumns({c: F.col(f"_hit.{c}") for c in names}).drop("_pos", "_hit")
