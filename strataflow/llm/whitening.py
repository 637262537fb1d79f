"""Whitening of embeddings by shifted Cholesky QR.

The centred rows are never gathered: each pass sums their Gram matrix over the table, the driver factors
it, and the next pass solves the rows against the triangular factors so far.  The singular values of the
composed triangle are those of the table of centred rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, OFFSET = 64, 1_000_000
LONG = 2**63
MOST_PASSES = 8
# A direction whose deviation is below this share of the largest is rounding, not data.
LEAST_SHARE = 3e-11


@dataclass
class Centre:
    """Count, exact sums per dimension and value range of the fixed-point vectors."""

    n: int
    sums: list[int]
    low: int
    high: int

    @property
    def dims(self) -> int:
        return len(self.sums)


@dataclass
class Model:
    centre: Centre
    components: np.ndarray  # one unit vector per row
    variances: np.ndarray
    trace: float
    identity_error: float


def fixed_point(vectors: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the usable vectors of a column and their entries floor(64*c)+1000000 as longs.

    A vector is unusable if it is null or holds a null or non-finite entry.  A short vector is filled up
    with entries 0.  Entries beyond the range of a long are cut to it.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    present = np.asarray(vectors.is_valid())
    lengths = np.where(present, np.diff(offsets), 0)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)[np.repeat(offsets[:-1], lengths) + at]
    bad = ~present
    bad[row[~np.isfinite(values)]] = True
    good = np.flatnonzero(~bad)
    if dims is None:
        dims = int(lengths[good].max(initial=0))
    place = np.cumsum(~bad) - 1
    use = ~bad[row]
    dense = np.zeros((len(good), dims))
    dense[place[row[use]], at[use]] = values[use]
    scaled = np.floor(SCALE * dense)
    # Doubles next to the ends of the range of a long.
    return good, np.clip(scaled, -(2.0**63 - 2**21), 2.0**63 - 2**21).astype(np.int64) + OFFSET


def fit_centre(df: DataFrame, vector: str) -> Centre:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, rows, low, high = 0, [], [], LONG, -LONG
        for batch in batches:
            good, x = fixed_point(batch.column(0))
            if not len(good):
                continue
            n += len(good)
            grow = x.shape[1] - len(sums)
            sums += [0] * grow
            rows += [0] * grow
            # Halves of the words are summed apart, so that no sum of a batch overflows.
            upper, lower = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            for i in range(x.shape[1]):
                sums[i] += (int(upper[i]) << 32) + int(lower[i])
                rows[i] += len(good)
            if x.size:
                low, high = min(low, int(x.min())), max(high, int(x.max()))
        if n:
            yield pa.RecordBatch.from_pylist(
                [{"dim": -1, "sum": "0", "rows": n, "low": None, "high": None}]
                + [{"dim": i, "sum": str(s), "rows": r, "low": low, "high": high} for i, (s, r) in enumerate(zip(sums, rows))],
                schema=pa.schema([("dim", pa.int32()), ("sum", pa.string()), ("rows", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]),
            )

    part = df.select(vector).mapInArrow(run, "dim int, sum string, rows long, low long, high long")
    total = part.groupBy("dim").agg(
        F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    found = {r["dim"]: r for r in total.collect()}  # a row per dimension
    if not found:
        return Centre(0, [], 0, 0)
    n = found.pop(-1)["rows"]
    sums = [int(found[i]["sum"]) + (n - found[i]["rows"]) * OFFSET for i in range(len(found))]
    lows = [OFFSET, *[r["low"] for r in found.values()]]
    highs = [OFFSET, *[r["high"] for r in found.values()]]
    return Centre(n, sums, min(lows), max(highs))


def multiples(x: np.ndarray, centre: Centre) -> np.ndarray:
    """n*x - S as longs that wrap; exact where the true value is a long."""
    wrapped = np.array([s % 2**64 for s in centre.sums], dtype=np.uint64).view(np.int64)
    return np.int64(centre.n) * x - wrapped


def centred(x: np.ndarray, centre: Centre) -> np.ndarray:
    if centre.n * (centre.high - centre.low) < LONG:
        return multiples(x, centre) / float(centre.n)
    means = np.array([[s // centre.n, (s % centre.n) / centre.n] for s in centre.sums])
    return (x - means[:, 0]) - means[:, 1]


def deviations(x: np.ndarray, centre: Centre) -> list[int | None]:
    """Sum of (n*x-S)^2 per row, exact; None where it is no long."""
    d = multiples(x, centre)
    wraps = centre.n * (centre.high - centre.low) >= LONG
    rough = (centred(x, centre) * centre.n).astype(np.float64)
    rough = (rough * rough).sum(axis=1)
    total = (d * d).sum(axis=1)  # modulo 2**64: exact if the true sum is a long
    out = total.tolist()
    for i in np.flatnonzero(rough > 9e18) if not wraps else range(len(x)):
        exact = sum((centre.n * int(v) - s) ** 2 for v, s in zip(x[i].tolist(), centre.sums))
        out[i] = exact if exact < LONG else None
    return out


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows * upper^-1 by forward substitution over the columns."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def gram(df: DataFrame, vector: str, centre: Centre, change: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over the usable rows of q'q, q the changed centred row: one triangle per task is shuffled."""
    i, j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            good, x = fixed_point(batch.column(0), centre.dims)
            if len(good):
                q = change(centred(x, centre))
                total += q.T @ q
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(i), dtype=np.int32)), pa.array(total[i, j])], names=["at", "part"])

    parts = df.select(vector).mapInArrow(run, "at int, part double")
    out = np.zeros((width, width))
    for row in parts.groupBy("at").agg(F.sum("part").alias("total")).collect():  # width^2/2 rows
        out[i[row["at"]], j[row["at"]]] = out[j[row["at"]], i[row["at"]]] = row["total"]
    return out


def fit(df: DataFrame, vector: str = "embedding", most: int = 32) -> Model:
    """Principal components of all usable vectors and their variances, at most ``most``.

    Passes over the table: exact sums, Gram matrices of shifted Cholesky QR until the rows are orthogonal,
    and one that measures the covariance of the whitened rows.  The first pass is always shifted, later ones
    only if their Gram matrix is near singular.  The last Gram matrix enters by its root, so that directions
    without any deviation come out as such and are left out.  Driver and tasks hold some matrices of
    dimensions by dimensions, whatever the number of rows.
    """
    centre = fit_centre(df, vector)
    n, d = centre.n, centre.dims
    nothing = Model(centre, np.zeros((0, d)), np.zeros(0), 0.0, 0.0)
    if not n or not d:
        return nothing
    unit = np.finfo(float).eps / 2
    floor = 64 * d * unit
    factors: list[np.ndarray] = []

    def orthogonal(rows: np.ndarray) -> np.ndarray:
        for upper in factors:
            rows = solved(rows, upper)
        return rows

    composed = np.eye(d)
    for step in range(MOST_PASSES):
        g = gram(df, vector, centre, orthogonal, d)
        values, vectors = np.linalg.eigh(g)
        if values[-1] <= 0:
            return nothing
        live = values > floor
        if step >= 2 and (np.abs(values[live] - 1) < 1e-3).all():
            break
        shift = 0.0
        if step == 0 or values[0] < 1e-3 * values[-1]:
            shift = 11 * (n * d + d * (d + 1)) * unit * values[-1]
            shift = min(shift, 1e-3 * values[-1])
        upper = np.linalg.cholesky(g + shift * np.eye(d)).T
        factors.append(upper)
        composed = upper @ composed
    root = np.sqrt(np.where(live, values, 0))[:, None] * vectors.T
    _, singular, right = np.linalg.svd(root @ composed)
    right = right * np.where(right[np.arange(d), np.abs(right).argmax(axis=1)] < 0, -1, 1)[:, None]
    variances = singular**2 / n
    count = min(most, int((singular > LEAST_SHARE * singular[0]).sum()))
    model = Model(centre, right[:count], variances[:count], float(variances.sum()), 0.0)
    covariance = gram(df, vector, centre, lambda rows: project(rows, model), count) / n
    model.identity_error = float(np.abs(covariance - np.eye(count)).max())
    return model


def project(rows: np.ndarray, model: Model) -> np.ndarray:
    return rows @ model.components.T / np.sqrt(model.variances)


def whiten(df: DataFrame, model: Model, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per usable vector: ``key``, ``deviation`` and the array ``whitened``, a value per component.

    Null vectors and those with a null or non-finite entry give no row; vectors shorter than the longest
    are filled up with zeros; an empty vector is all zeros.  Null and repeated keys stay, row by row; an empty
    table gives no rows and other columns are not read.  If all vectors are equal there is no component and
    the array is empty.  ``deviation`` is null where it is no long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = fixed_point(batch.column(1), model.centre.dims)
            if not len(good):
                continue
            y = project(centred(x, model.centre), model)
            arrays = [
                batch.column(0).take(pa.array(good)),
                pa.array(deviations(x, model.centre), pa.int64()),
                pa.array(list(y), pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "deviation", "whitened"])

    schema = T.StructType(
        [T.StructField("key", df.schema[key].dataType), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    )
    return df.select(key, vector).mapInArrow(run, schema).withColumnRenamed("key", key)
