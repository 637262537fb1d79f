"""Ordered scans that never put a whole key into one task.

A well may own a third of all rows, so ``Window.partitionBy(well)`` is no option for rows.
Each scan cuts a key into chunks of its own order.  Rows meet in windows over (key, chunk) only; what
crosses a chunk border travels through one summary row per chunk, and only those summaries are
windowed per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_BLOCK = 1_000_000


@dataclass(frozen=True)
class Cut:
    """Chunks of an order: its first ``whole`` columns as they are, then ``part`` of the next one.

    ``part`` must never fall while its column rises; then chunks rise with the order, whatever the rows.
    """

    part: Callable[[Column], Column]
    whole: int = 0

    def columns(self, order: Sequence[str]) -> list[Column]:
        return [*[F.col(c) for c in order[: self.whole]], self.part(F.col(order[self.whole]))]


# (date, unique id): one chunk per date and block of ids.
BY_DAY_AND_ID = Cut(lambda c: F.floor(c / F.lit(ID_BLOCK)), whole=1)
# (timestamp, ...): one chunk per hour.
BY_HOUR = Cut(lambda c: F.date_trunc("hour", c))


def by_depth(width: float) -> Cut:
    """(depth, ...): one chunk per ``width`` metres."""
    return Cut(lambda c: F.floor(c / F.lit(float(width))))


def never_null(df: DataFrame, by: Sequence[str]) -> list[Column]:
    """For each key column a text that is equal where the keys are; that of a NULL key is empty."""
    out = []
    for c in by:
        # 0.0 and -0.0 are one key.
        value = F.col(c) + F.lit(0.0) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c)
        out.append(F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("")))
    return out


def scan(
    df: DataFrame,
    by: Sequence[str],
    cut: Cut,
    order: Sequence[str],
    *,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    last_known: dict[str, Column] | None = None,
    next_known: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
) -> DataFrame:
    """Add columns that depend on the order of rows within a key.

    Chunks are cut from ``order``, which must be unique and not NULL; a NULL key is a key like any.
    lag / lead: value of the neighbouring row.  last_known / next_known: nearest non-NULL value
    strictly before / after the row.  total: running sum up to and including the row.
    """
    lag, lead, total = lag or {}, lead or {}, total or {}
    last_known, next_known = last_known or {}, next_known or {}
    chunks = cut.columns(order)
    marks = [f"_c_{i}" for i in range(len(chunks))]
    hidden_by = {f"_b_{i}": key for i, key in enumerate(never_null(df, by))}
    df = df.withColumns(hidden_by | dict(zip(marks, chunks)))
    position = F.struct(*[F.col(c) for c in order])

    # Keys that are never NULL are joined by plain equality, on the partitioning the rows have already.
    given, by = list(by), list(hidden_by)
    rows = Window.partitionBy(*by, *marks)
    up = rows.orderBy(*order)
    down = rows.orderBy(*[F.desc(c) for c in order])
    before = (Window.unboundedPreceding, -1)

    # Values are wrapped, so that a NULL value differs from "no such row".
    local = (
        {f"_l_{n}": F.lag(F.struct(v.alias("v"))).over(up) for n, v in lag.items()}
        | {f"_l_{n}": F.lead(F.struct(v.alias("v"))).over(up) for n, v in lead.items()}
        | {f"_l_{n}": F.last(v, True).over(up.rowsBetween(*before)) for n, v in last_known.items()}
        | {f"_l_{n}": F.last(v, True).over(down.rowsBetween(*before)) for n, v in next_known.items()}
        | {
            f"_l_{n}": F.sum(v).over(up.rowsBetween(Window.unboundedPreceding, 0))
            for n, v in total.items()
        }
    )
    summary = df.groupBy(*given, *by, *marks).agg(
        *[F.max_by(F.struct(v.alias("v")), position).alias(f"_s_{n}") for n, v in lag.items()],
        *[F.min_by(F.struct(v.alias("v")), position).alias(f"_s_{n}") for n, v in lead.items()],
        *[
            F.max_by(v, F.when(v.isNotNull(), position)).alias(f"_s_{n}")
            for n, v in last_known.items()
        ],
        *[
            F.min_by(v, F.when(v.isNotNull(), position)).alias(f"_s_{n}")
            for n, v in next_known.items()
        ],
        *[F.sum(v).alias(f"_s_{n}") for n, v in total.items()],
    )
    keys = Window.partitionBy(*given)
    chunks_up = keys.orderBy(*marks)
    chunks_down = keys.orderBy(*[F.desc(m) for m in marks])
    carried = summary.select(
        *by,
        *marks,
        *[
            F.last(f"_s_{n}", True).over(chunks_up.rowsBetween(*before)).alias(f"_k_{n}")
            for n in [*lag, *last_known]
        ],
        *[
            F.last(f"_s_{n}", True).over(chunks_down.rowsBetween(*before)).alias(f"_k_{n}")
            for n in [*lead, *next_known]
        ],
        *[
            F.sum(f"_s_{n}").over(chunks_up.rowsBetween(*before)).alias(f"_k_{n}")
            for n in total
        ],
    )
    rows_, keys_ = df.withColumns(local), [*by, *marks]
    side = carried.select(*[F.col(c).alias(f"_j_{c}") for c in keys_], *[c for c in carried.columns if c.startswith("_k_")])
    same = F.lit(True)
    for c in keys_:
        same = same & (F.col(c) == F.col(f"_j_{c}"))
    joined = rows_.join(side, same, "left")

    def near(name: str) -> Column:
        return F.coalesce(F.col(f"_l_{name}"), F.col(f"_k_{name}"))

    added = (
        {n: near(n)["v"] for n in [*lag, *lead]}
        | {n: near(n) for n in [*last_known, *next_known]}
        | {
            n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_k_{n}"), F.lit(0))
            for n in total
        }
    )
    hidden = [*by, *marks, *local, *[c for c in side.columns if c.startswith(("_k_", "_j_"))]]
    return joined.withColumns(added).drop(*hidden)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ranked_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None, name: str = "rank_no") -> DataFrame:
    """First k rows per key, or all of them numbered.  Spark cuts to k per map task before it shuffles."""
    window = Window.partitionBy(*by).orderBy(*order)
    numbered = df.withColumn(name, F.row_number().over(window))
    return numbered if k is None else numbered.filter(F.col(name) <= k)


def value_range(value: Column, per_doubling: int = 256) -> Column:
    """Number of a value's range; never falls while the value rises.

    Ranges are relative (``per_doubling`` to a factor of two, either sign), so one huge value leaves the
    others spread as they were.  NULL has no range.
    """
    v = value.cast("double")
    size = F.floor(F.log2(F.greatest(F.abs(v), F.lit(1e-300))) * per_doubling).cast("long") + 1_000 * per_doubling
    return F.when(v > 0, size).when(v < 0, -size).when(v == 0, F.lit(0).cast("long"))


def running_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per key and distinct value: ``n`` rows, ``upto`` rows of no larger value, ``total`` rows of the key.

    Equal values are counted first.  Ranges of values carry the counts before them, and values are
    ordered inside their range only, so no task holds the values of a key.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count("*").alias("n"))
        .withColumn("_range", value_range(F.col(value)))
    )
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        counted.groupBy(*by, "_range")
        .agg(F.sum("n").alias("_n"))
        .select(
            *by,
            "_range",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(whole).alias("total"),
        )
    )
    inside = Window.partitionBy(*by, "_range").orderBy(value)
    return (
        counted.withColumn("_inside", F.sum("n").over(inside))
        .join(ranges, [*by, "_range"])
        .withColumn("upto", F.col("_before") + F.col("_inside"))
        .drop("_range", "_before", "_inside")
    )


def upper_median(df: DataFrame, by: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """``sorted(values)[n // 2]`` per key without gathering the values of a key."""
    middle = F.col("upto") > F.floor(F.col("total") / 2)
    return running_counts(df, by, value).filter(middle).groupBy(*by).agg(F.min(value).alias(out))
