"""Exact duplicates by two passes over a Bloom filter.

The first pass writes every text's hash into a filter with two bits per position: seen, and seen again.
A text that occurs twice has all its positions seen again, so the second pass lets every other row
through as it is; only rows that may have a copy are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Positions of a block; both positions of a hash lie in one block, so a row meets one row of the filter.
BLOCK_BITS = 18
BLOCK = 1 << BLOCK_BITS
# A filter has at most this many blocks (64 MB), however large the table: it is broadcast.
MOST_BLOCKS = 2_048
FLUSH = 1 << 20
# A group of more than one row in so many is joined by broadcast; there are fewer such groups than that.
HOT_SHARE = 1_000


def normalised(text: str | Column = "text") -> Column:
    """The text with A-Z in lower case; null counts as empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, UPPER.lower())


def blocks_for(rows: int, bits_per_row: int) -> int:
    return min(MOST_BLOCKS, max(1, -(-rows * bits_per_row // BLOCK)))


def positions(digest: str, blocks: int) -> tuple[Column, Column, Column]:
    """Block and the two positions inside it, from the leading bytes of a SHA-256."""
    h = F.xxhash64(digest)
    block = F.pmod(h, F.lit(blocks)).cast("int")
    low = F.shiftrightunsigned(h, 11)
    first = low.bitwiseAND(BLOCK - 1).cast("int")
    step = F.shiftrightunsigned(low, BLOCK_BITS).bitwiseAND(BLOCK - 2).cast("int")
    # An odd step of less than a block: the second position is never the first.
    return block, first, (first + step + 1).bitwiseAND(BLOCK - 1)


def coded(at: np.ndarray) -> bytes:
    """Positions inside a block: sorted 32-bit words, or a bit map where that is smaller."""
    if len(at) * 32 < BLOCK:
        return at.astype("<u4").tobytes()
    bits = np.zeros(BLOCK, dtype=np.uint8)
    bits[at] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def decoded(data: bytes) -> np.ndarray:
    if len(data) * 8 < BLOCK:
        return np.frombuffer(data, dtype="<u4").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little"))


def partial_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block that a run of rows touches: the positions it sees, and those it sees again."""

    def flush():
        at, times = np.unique(np.concatenate(waiting), return_counts=True)
        block = at >> BLOCK_BITS
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        inside, again = at & (BLOCK - 1), times > 1
        rows = []
        for i, start in enumerate(starts):
            end = starts[i + 1] if i + 1 < len(starts) else len(at)
            part = inside[start:end]
            rows.append((int(block[start]), coded(part), coded(part[again[start:end]])))
        for i in range(0, len(rows), 500):
            columns = list(zip(*rows[i : i + 500]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
                names=["block", "seen", "again"],
            )

    waiting, n = [], 0
    for batch in batches:
        block, first, second = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
        waiting += [(block << BLOCK_BITS) + first, (block << BLOCK_BITS) + second]
        n += len(block)
        if n >= FLUSH:
            yield from flush()
            waiting, n = [], 0
    if n:
        yield from flush()


def merged_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block from partial rows in block order: the bit map of what was seen again, as longs."""

    def row():
        words = np.packbits(again, bitorder="little").view("<i8")
        return pa.RecordBatch.from_arrays(
            [pa.array([current], pa.int32()), pa.array([words], pa.list_(pa.int64()))], names=["block", "words"]
        )

    current = None
    for batch in batches:
        for block, one, two in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if block != current:
                if current is not None:
                    yield row()
                current, seen, again = block, np.zeros(BLOCK, dtype=bool), np.zeros(BLOCK, dtype=bool)
            at = decoded(one)
            again[at[seen[at]]] = True
            seen[at] = True
            again[decoded(two)] = True
    if current is not None:
        yield row()


def repeat_filter(rows: DataFrame, digest: str, blocks: int) -> DataFrame:
    """``block, words``: the positions that the hashes of ``rows`` reach more than once."""
    partial = rows.select(*positions(digest, blocks)).mapInArrow(partial_filters, "block int, seen binary, again binary")
    ordered = partial.repartition("block").sortWithinPartitions("block")
    return ordered.mapInArrow(merged_filters, "block int, words array<bigint>")


def probed(rows: DataFrame, digest: str, found: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``suspect``: whether all positions of the hash were reached more than once.

    The filter has at most MOST_BLOCKS rows of 32 kB, so it may be broadcast at any size of the table.
    """
    block, first, second = positions(digest, blocks)

    def bit(at: Column) -> Column:
        word = F.element_at("words", F.shiftright(at, 6) + 1)
        return F.call_function("shiftright", word, at.bitwiseAND(63)).bitwiseAND(F.lit(1)) == 1

    at = rows.withColumns({"block": block, "first": first, "second": second})
    joined = at.join(F.broadcast(found), "block", "left")
    suspect = F.coalesce(bit(F.col("first")) & bit(F.col("second")), F.lit(False))
    return joined.select(*rows.columns, suspect.alias("suspect"))


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits_per_row: int = 16) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are identical after lower-casing A-Z, which SHA-256 stands for.  The row of
    largest id stays; a null id is smaller than any; of rows of equal id and text the last read stays, the
    others are dropped.  ``keep_id`` is null where no row of a group has an id.  A null text equals an
    empty one.  Texts are read whole, once, whatever their length.  An empty table gives no rows; other
    columns are not read.  Beyond 2**29 / ``bits_per_row`` rows the filter grows no more and lets more rows
    be shuffled; the result is the same.
    """
    narrow = kept(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.monotonically_increasing_id().alias("row_no"),
            F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
        )
    )
    n = narrow.count()
    blocks = blocks_for(n, bits_per_row)
    found = kept(repeat_filter(narrow, "digest", blocks))
    rows = probed(narrow, "digest", found, blocks)
    last = F.max(F.struct("doc_id", "row_no"))
    suspects = rows.filter("suspect").select("doc_id", "row_no", "digest")
    groups = kept(suspects.groupBy("digest").agg(F.count("*").alias("group_size"), last.alias("last")))

    hot = groups.filter(F.col("group_size") * HOT_SHARE > n)
    rest = groups.filter(F.col("group_size") * HOT_SHARE <= n)
    flagged = suspects.join(F.broadcast(hot.select("digest", F.col("group_size").alias("hot_size"), F.col("last").alias("hot_last"))), "digest", "left")
    in_hot = flagged.filter("hot_size is not null").selectExpr("doc_id", "row_no", "digest", "hot_size as group_size", "hot_last as last")
    in_rest = flagged.filter("hot_size is null").select("doc_id", "row_no", "digest").join(rest, "digest")
    alone = rows.filter("not suspect").select(
        "doc_id", "row_no", "digest", F.lit(1).cast("long").alias("group_size"), F.struct("doc_id", "row_no").alias("last")
    )
    parts = [df.select("doc_id", "row_no", "digest", "group_size", "last") for df in (alone, in_hot, in_rest)]
    return (
        parts[0].unionByName(parts[1]).unionByName(parts[2])
        .select(
            "doc_id",
            F.col("last.doc_id").alias("keep_id"),
            "group_size",
            (F.col("row_no") == F.col("last.row_no")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits_per_row: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that cannot have a copy pass without a shuffle; suspects are cut to one row per text.  Ids, nulls and
    ties count as in ``mark``; of rows of equal id and text any one stays.
    """
    fields = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in fields]).alias("row"))
    row = row.select("row", F.unhex(F.sha2(normalised(F.col("row").getField(text)), 256)).alias("digest"))
    n = docs.count()
    blocks = blocks_for(n, bits_per_row)
    found = kept(repeat_filter(row.select("digest"), "digest", blocks))
    rows = probed(row, "digest", found, blocks)
    one = rows.filter("suspect").groupBy("digest").agg(F.max_by("row", F.struct(F.col("row").getField(doc_id))).alias("row"))
    alone = rows.filter("not suspect").select("row")
    return alone.unionByName(one.select("row")).select(*[F.col("row").getField(c).alias(c) for c in fields])
