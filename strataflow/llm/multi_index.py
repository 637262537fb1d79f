"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised by a codebook of its own; a pair of centroids is a cell.  A query
walks the cells in ascending summed distance, with a heap, until they hold a number of entries,
and those entries are ranked by their exact distance.  That number is measured: a few queries are answered
exactly, and it is the least one that finds the aimed share of their neighbours.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

# Centroids of a half: about 50 entries a cell, up to 65,536 cells; larger tables have fuller cells.
FEWEST_CENTROIDS = 16
MOST_CENTROIDS = 256
SAMPLE_VECTORS = 4_096
# Share of the trial queries' neighbours that the walk must reach, and the number of trial queries.
RECALL = 0.95
TRIAL_QUERIES = 128
PART_ROWS = 20_000
QUERY_BLOCK = 5_000
NEAREST = 10
QUERY_EVERY = 100


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part: all components finite, not all zero, of the usual length.

    Rows without vec_id and rows whose length is not the most frequent one take no part either.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (usual["n"] if usual else -1))


def k_means(x: np.ndarray, k: int, rounds: int = 15, seed: int = 0) -> np.ndarray:
    """Codebook of at most k rows: distinct starting points, plain iterations."""
    points = np.unique(x, axis=0)
    k = min(k, len(points))
    centre = points[np.random.default_rng(seed).choice(len(points), k, replace=False)]
    for _ in range(rounds):
        of = nearest_centre(x, centre)
        for j in range(k):
            mine = x[of == j]
            if len(mine):
                centre[j] = mine.mean(axis=0)
    # In order along their longest axis, so that neighbouring numbers are mostly neighbours.
    axis = np.linalg.svd(centre - centre.mean(axis=0), full_matrices=False)[2][0]
    return centre[np.argsort(centre @ axis, kind="stable")]


def centroids_for(total: int) -> int:
    return min(MOST_CENTROIDS, max(FEWEST_CENTROIDS, math.isqrt(total) // 7))


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1)[None]


def nearest_centre(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return squared(x, centre).argmin(axis=1)


def codebooks(rows: DataFrame, k: int, sample: int = SAMPLE_VECTORS) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of both halves, fitted on at most ``sample`` vectors, one per hash bucket of the id."""
    hashed = F.xxhash64("vec_id")
    ids = rows.groupBy(F.pmod(hashed, F.lit(sample)).alias("b")).agg(F.min_by("vec_id", F.struct(hashed, "vec_id")).alias("vec_id"))
    wanted = [r["vec_id"] for r in ids.select("vec_id").collect()]
    taken = rows.filter(F.col("vec_id").isin(wanted)).dropDuplicates(["vec_id"]).orderBy("vec_id").toPandas() if wanted else None
    if taken is None or not len(taken):
        return np.zeros((1, 1)), np.zeros((1, 1))
    x = np.stack(taken["v"].to_numpy())
    half = (x.shape[1] + 1) // 2
    return k_means(x[:, :half], k), k_means(x[:, half:], k) if x.shape[1] > half else np.zeros((1, 0))


def cells_of(x: np.ndarray, books) -> np.ndarray:
    half = books[0].shape[1]
    return nearest_centre(x[:, :half], books[0]) * len(books[1]) + nearest_centre(x[:, half:], books[1])


def walk(query: np.ndarray, books, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in ascending summed distance until they hold ``wanted`` entries.

    Both halves' centroids are sorted by distance; a pair enters the heap once its left and upper neighbours
    in that order have been taken, so the heap stays small.
    """
    half = books[0].shape[1]
    d1, d2 = squared(query[None, :half], books[0])[0], squared(query[None, half:], books[1])[0]
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1], d2[o2]
    heap, taken, out, held = [(s1[0] + s2[0], 0, 0)], set(), [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        taken.add((i, j))
        cell = int(o1[i]) * len(o2) + int(o2[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        if i + 1 < len(s1) and (j == 0 or (i + 1, j - 1) in taken):
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        if j + 1 < len(s2) and (i == 0 or (i - 1, j + 1) in taken):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
    return out


def nearest_cells(entries: DataFrame, trial: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query, cell): the cells of the exactly nearest k entries of each trial query, its own rows left out."""
    own, q = trial["vec_id"].to_numpy(), np.stack(trial["v"].to_numpy())

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far, near = np.full((0, len(q)), np.inf), np.zeros((0, len(q)), dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            d = squared(np.stack(batch["v"].to_numpy()), q)
            d[batch["vec_id"].to_numpy()[:, None] == own[None]] = np.inf
            cell = np.broadcast_to(batch["cell"].to_numpy(np.int64)[:, None], d.shape)
            far, near = np.concatenate([far, d]), np.concatenate([near, cell])
            if len(far) > k:
                at = np.argpartition(far, k - 1, axis=0)[:k]
                far, near = np.take_along_axis(far, at, 0), np.take_along_axis(near, at, 0)
        at, query = np.nonzero(np.isfinite(far))
        yield pd.DataFrame({"query": query, "d": far[at, query], "cell": near[at, query]})

    found = entries.mapInPandas(best, "query long, d double, cell long")
    order = Window.partitionBy("query").orderBy("d", "cell")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("query", "cell").toPandas()


def entries_needed(entries: DataFrame, asked: DataFrame, books, counts: np.ndarray, k: int, recall: float, trial: int) -> int:
    """Entries that a walk must hold to reach ``recall`` of the neighbours of at most ``trial`` queries.

    The trial queries are one per hash bucket; they are compared with every entry, on the executors.
    """
    bucket = F.pmod(F.xxhash64("vec_id"), F.lit(trial))
    chosen = asked.groupBy(bucket.alias("b")).agg(F.min_by(F.struct("vec_id", "v"), "vec_id").alias("r")).select("r.*").orderBy("vec_id").toPandas()
    if not len(chosen):
        return 0
    true = nearest_cells(entries, chosen, k)
    if not len(true):
        return 0
    half, needed = books[0].shape[1], []
    q = np.stack(chosen["v"].to_numpy())
    for number, part in true.groupby("query"):
        d = squared(q[number : number + 1, :half], books[0])[0][:, None] + squared(q[number : number + 1, half:], books[1])[0][None]
        order = np.argsort(d.ravel(), kind="stable")
        before = np.empty(len(order), dtype=np.int64)
        before[order] = np.cumsum(counts[order]) - counts[order]
        needed.extend((before[part["cell"].to_numpy()] + 1).tolist())
    return int(np.quantile(needed, recall, method="higher"))


def by_part(seen: np.ndarray, offset: np.ndarray, counts: np.ndarray, rows: int) -> tuple[np.ndarray, list[bytes]]:
    """The parts of ``rows`` rows that hold the cells, and for each the cells in it as 32-bit numbers."""
    first, last = offset[seen] // rows, (offset[seen] + counts[seen] - 1) // rows
    n = last - first + 1
    part = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order = np.argsort(part, kind="stable")
    part, cell = part[order], np.repeat(seen, n)[order].astype("<i4")
    parts, start = np.unique(part, return_index=True)
    return parts, [c.tobytes() for c in np.split(cell, start[1:])]


def rank(queries: pd.DataFrame, entries: pd.DataFrame, n_cells: int, k: int) -> pd.DataFrame:
    """The k nearest entries of each query among its cells, ties to smaller ids."""
    if not len(queries) or not len(entries):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    x, ids, cell = np.stack(entries["v"].to_numpy()), entries["vec_id"].to_numpy(), entries["cell"].to_numpy()
    length = (x * x).sum(1)
    out, open_ = [], np.zeros(n_cells, bool)
    for query_id, q, cells in zip(queries["query_id"], queries["v"], queries["cells"]):
        open_[:] = False
        open_[np.frombuffer(cells, "<i4")] = True
        at = np.flatnonzero(open_[cell] & (ids != query_id))
        if not len(at):
            continue
        q = np.asarray(q, dtype=np.float64)
        rough = length[at] - 2 * (x[at] @ q)
        if len(at) > k:
            # Rounding must not decide: whatever may still be among the k is measured exactly.
            edge = np.partition(rough, k - 1)[k - 1]
            at = at[rough <= edge + 1e-9 * (1 + abs(edge) + float(q @ q))]
        exact = np.sqrt(((x[at] - q) ** 2).sum(axis=1))
        best = np.lexsort((ids[at], exact))[:k]
        out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[at][best], "score": exact[best]}))
    return pd.concat(out, ignore_index=True) if out else rank(queries.iloc[:0], entries, n_cells, k)


def search(
    vectors: DataFrame,
    k: int = NEAREST,
    every: int = QUERY_EVERY,
    centroids: int | None = None,
    share: float | None = None,
    sample: int = SAMPLE_VECTORS,
    recall: float = RECALL,
    trial: int = TRIAL_QUERIES,
    part_rows: int = PART_ROWS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every query: a row whose vec_id is divisible by ``every``.

    Reranked per query is ``share`` of all entries, or, if None, as many as reach ``recall`` of the neighbours of at
    most ``trial`` queries.  The distance is Euclidean, in double precision.  A query gets k entries, or
    all others if they are fewer.  See ``usable`` for what takes no part; an entry that repeats an id is an entry
    of its own, a repeated query is asked once, with its smallest vector.  An empty table gives no rows;
    other columns are not read.
    """
    rows = kept(usable(vectors))
    books = codebooks(rows, centroids or centroids_for(rows.count()), sample)
    n_cells = len(books[0]) * len(books[1])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=cells_of(np.stack(batch["v"].to_numpy()), books))

    entries = kept(rows.mapInPandas(assign, "vec_id long, v array<double>, cell int"))
    asked = (
        entries.filter(F.col("vec_id") % every == 0)
        .groupBy("vec_id")
        .agg(F.min(F.struct("v", "cell")).alias("r"), F.count("*").alias("copies"))
        .select("vec_id", "r.v", "r.cell", "copies")
    )

    def per_cell(df: DataFrame) -> np.ndarray:
        """At most one row per pair of centroids comes to the driver."""
        n = np.zeros(n_cells, dtype=np.int64)
        for row in df.groupBy("cell").count().collect():
            n[row["cell"]] = row["count"]
        return n

    counts, asked_counts = per_cell(entries), per_cell(asked)
    wanted = entries_needed(entries, asked, books, counts, k, recall, trial) if share is None else math.ceil(share * int(counts.sum())) + 1
    # Cells lie one after the other on a line that is cut into parts of about ``part_rows`` entries: small
    # cells share a part, and a cell of very many entries spans several.  Queries are cut into blocks
    # along the same line, so that those of a block walk much the same cells.
    offset, asked_offset = np.cumsum(counts) - counts, np.cumsum(asked_counts) - asked_counts

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            cell = batch["cell"].to_numpy()
            position = offset[cell] + batch["h"].to_numpy() % counts[cell]
            yield batch[["vec_id", "v", "cell"]].assign(part=position // part_rows)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            cell = batch["cell"].to_numpy()
            block = (asked_offset[cell] + batch["h"].to_numpy() % asked_counts[cell]) // query_block
            parts, cells = [], []
            for v, copies in zip(batch["v"], batch["copies"]):
                # A query's own rows are no candidates.
                seen = walk(np.asarray(v, dtype=np.float64), books, counts, max(wanted, k + copies))
                for out, found in zip((parts, cells), by_part(np.array(seen, dtype=np.int64), offset, counts, part_rows)):
                    out.append(found)
            yield pd.DataFrame({"query_id": batch["vec_id"], "v": batch["v"], "block": block, "parts": parts, "cells": cells})

    hashed = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 62)).alias("h")
    walked = kept(
        asked.select("*", hashed).mapInPandas(ask, "query_id long, v array<double>, block long, parts array<long>, cells array<binary>")
    )
    queries = walked.select("query_id", "v", F.col("block").alias("at_block"), F.inline(F.arrays_zip(F.col("parts").alias("at_part"), F.col("cells"))))
    # Entries go to the blocks that walk their part, and to no other.
    visits = walked.select("block", F.explode("parts").alias("part")).distinct()
    placed = entries.select("*", hashed).mapInPandas(spread, "vec_id long, v array<double>, cell int, part long").join(visits, "part")
    near = (
        queries.groupBy("at_part", "at_block")
        .cogroup(placed.groupBy("part", "block"))
        .applyInPandas(lambda q, e: rank(q, e, n_cells, k), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
