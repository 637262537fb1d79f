"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified distance, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import giving_back, kept, local_components
from .components import connected_components
from .frames import map_rows

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
UNIT_ROWS = 1_000
# Units of up to so many fingerprints are judged side by side.
FEW = 64


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64 majority bits of the shingles' XXH64; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxh64_intdigest(b" ".join(words), HASH_SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends.tolist()
    hashes = np.array(
        [xxh64_intdigest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[shingle_words - 1 :])],
        dtype="<u8",
    )
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 16_384):
        part = hashes[lo : lo + 16_384]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, out: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle_words) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({out: values.view(np.int64)})

    return map_rows(docs.drop(out), run, f"{out} long", reads=["text"])


def block_masks(n_blocks: int) -> list[int]:
    """64 bits cut into ``n_blocks`` runs of nearly equal length."""
    cuts = [64 * i // n_blocks for i in range(n_blocks + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def n_blocks_for(count: int, max_bits: int) -> int:
    """Blocks such that the bits of a table's key about tell ``count`` values apart.  Any number is exact."""
    n = max_bits + 2
    while n < max_bits + 5 and 64 * (n - max_bits) // n < np.log2(max(count, 2)) - 1:
        n += 1
    return n


def block_keys(fp: Column, max_bits: int, n_blocks: int) -> Column:
    """One key per choice of blocks that two fingerprints in reach must share.

    With ``n_blocks`` blocks and ``max_bits`` differing bits at least ``n_blocks - max_bits`` blocks agree.
    """
    masks = block_masks(n_blocks)
    tables = [
        signed(sum(masks[i] for i in chosen)) for chosen in combinations(range(n_blocks), n_blocks - max_bits)
    ]
    return F.array(*[F.struct(F.lit(i).alias("tbl"), fp.bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(tables)])


def forest(fp: np.ndarray, max_bits: int) -> pd.DataFrame:
    """Links that connect the fingerprints of one unit as all their pairs within ``max_bits`` would."""
    bits, n = fp.view(np.uint64), len(fp)
    found_a, found_b, held = [], [], 0
    for lag in range(1, n):
        near = np.flatnonzero(np.bitwise_count(bits[:-lag] ^ bits[lag:]) <= max_bits)
        found_a.append(near)
        found_b.append(near + lag)
        held += len(near)
        if held > 4 * n + 1_000_000:  # a forest says as much as all pairs
            label = local_components(n, np.concatenate(found_a), np.concatenate(found_b))
            tied = np.flatnonzero(label != np.arange(n))
            found_a, found_b, held = [tied], [label[tied]], 0
    if not held:
        return pd.DataFrame({"a": fp[:0], "b": fp[:0]})
    label = local_components(n, np.concatenate(found_a), np.concatenate(found_b))
    tied = np.flatnonzero(label != np.arange(n))
    return pd.DataFrame({"a": fp[tied], "b": fp[label[tied]]})


def small_forests(unit: np.ndarray, fp: np.ndarray, max_bits: int) -> pd.DataFrame:
    """``forest`` of many whole units at once, as most hold two or three fingerprints."""
    bits = fp.view(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(unit)]]))
    few = np.repeat(sizes <= FEW, sizes)
    ends = np.repeat(first + sizes, sizes)
    out, live, lag = [], np.flatnonzero(few), 1
    while len(live := live[live + lag < ends[live]]):
        near = live[np.bitwise_count(bits[live] ^ bits[live + lag]) <= max_bits]
        out.append(pd.DataFrame({"a": fp[near], "b": fp[near + lag]}))
        lag += 1
    out += [forest(fp[lo : lo + n], max_bits) for lo, n in zip(first[sizes > FEW].tolist(), sizes[sizes > FEW].tolist())]
    return pd.concat(out, ignore_index=True).drop_duplicates() if out else pd.DataFrame({"a": fp[:0], "b": fp[:0]})


def linked_in_units(max_bits: int):
    """Links of (unit, fp) rows that come sorted by unit.

    Whole units are judged as soon as the next one starts, so a task holds one Arrow batch and at most one unit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            unit, fp = batch["unit"].to_numpy(), batch["fp"].to_numpy()
            if not len(unit):
                continue
            last = int(np.searchsorted(unit, unit[-1]))  # start of the unit that may go on in the next batch
            if rest and (last or rest[-1][0][-1] != unit[0]):
                whole = [np.concatenate(x) for x in zip(*rest, (unit[:last], fp[:last]))]
                yield small_forests(*whole, max_bits)
                rest = []
            elif last:
                yield small_forests(unit[:last], fp[:last], max_bits)
            rest.append((unit[last:], fp[last:]))
        if rest:
            yield small_forests(*[np.concatenate(x) for x in zip(*rest)], max_bits)

    return run


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs within ``max_bits`` would.

    Fingerprints meet on shared blocks.  A block that holds many is dealt into parts, and each pair of parts
    is a unit of its own, so no task sees more than two parts of a block at once.  Within a unit every
    distance is computed; what leaves it is a forest, not its pairs.
    """
    n_blocks = n_blocks_for(distinct.count(), max_bits)
    keyed = distinct.select("fp", F.inline(block_keys(F.col("fp"), max_bits, n_blocks)))
    sizes = keyed.groupBy("tbl", "key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / unit_rows).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    units = (
        keyed.join(sizes, ["tbl", "key"])
        .withColumn("parts", parts)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.xxhash64("tbl", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), "fp")
    )
    return units.repartition("unit").sortWithinPartitions("unit").mapInPandas(giving_back(linked_in_units(max_bits)), "a long, b long").distinct()


def rooted(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Adds ``root``, the fingerprint that stands for its component, to one row per fingerprint."""
    roots = connected_components(near_links(nodes.select("fp"), max_bits))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return named.withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id``: per row the smallest doc_id reachable over links of at most ``max_bits`` bits.

    A null, empty or wordless text has fingerprint 0 and links like any other.  Equal fingerprints are one
    node, so copies cost nothing.  A null doc_id never names a component unless it is alone in it (then
    null); repeated rows are returned each; an empty table gives no rows; other columns are not read.
    """
    marked = kept(fingerprints(docs.select("doc_id", "text"), shingle_words).select("doc_id", "fp"))
    named = rooted(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), max_bits)
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = named.join(ids, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, text_hash`` of one row per component: the smallest id, nulls last, then the smallest hash.

    The two name a row, so neither rows that share an id nor rows without one stand for each other.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    marked = kept(fingerprints(hashed, shingle_words).select("doc_id", "text_hash", "fp"))
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    named = rooted(marked.groupBy("fp").agg(F.min(key).alias("key")), max_bits)
    return named.groupBy("root").agg(F.min("key").alias("key")).select("key.doc_id", "key.text_hash")
