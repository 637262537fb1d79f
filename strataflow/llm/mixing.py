"""Mixing sources to target weights by blocks of words.

The words of a source, its documents in a pseudorandom order, are cut into blocks of fixed length.  Every
output shard draws how many blocks it takes of each source; the draws of a source are numbered
through, the numbers are mapped to blocks by a pseudorandom permutation of the source's block
indexes, and the blocks are joined by index.  A source that is taken more than once starts a new
permutation for every pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, buckets_for, giving_back, kept, mix64
from .frames import map_rows

# Fixed values of the production mix.
WEIGHTS = (3.0, 1.0, 2.0)
VOLUME = 1.5
MOST_REPEATS = 2.0
BLOCK_WORDS = 64
SHARD_SLOTS = 4_096
BUCKET_DOCUMENTS = 1_000
MOST_BUCKETS = 100_000
SEED = 17


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], volume: float, most: float) -> np.ndarray:
    """Words to take per source: ``volume`` times all words shared by weight, none above ``most`` times its size."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    caps, out = most * sizes, np.zeros(len(sizes))
    open_ = np.ones(len(sizes), bool)
    left = min(volume * sizes.sum(), caps.sum())
    while open_.any():
        share = left * weights / weights[open_].sum()
        over = open_ & (share > caps)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = caps[over]
        left -= caps[over].sum()
        open_ &= ~over
    return out


def catalogue(sized: DataFrame, weights: Sequence[float], volume: float, most: float, block: int) -> pd.DataFrame:
    """One row per source, in code point order, null last: size, target, blocks and slots.

    One small row per source comes to the driver, never anything per document.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = np.array([r["size"] for r in rows], dtype=np.int64)
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], volume, most)
    blocks = -(-sizes // block)
    passes = np.floor(np.divide(target, sizes, out=np.zeros(len(rows)), where=sizes > 0)).astype(np.int64)
    rest = np.minimum(np.rint((target - passes * sizes) / block).astype(np.int64), blocks)
    return pd.DataFrame(
        {
            "source": pd.Series([r["source"] for r in rows], dtype=object),
            "source_no": np.arange(len(rows)),
            "source_size": sizes,
            "target": target,
            "blocks": blocks,
            "slots": np.where(passes >= most, passes * blocks, passes * blocks + rest),
        }
    )


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Bijection of 0..size-1 per key: a four-round Feistel network, walked until it falls inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    live = np.arange(len(out))
    while len(live):
        left, right = out[live] >> half[live], out[live] & low[live]
        for round_ in range(4):
            salt = mix64(key[live] + np.uint64(round_))
            left, right = right, left ^ (mix64(right ^ salt) & low[live])
        out[live] = (left << half[live]) | right
        live = live[out[live] >= size[live].astype(np.uint64)]
    return out.astype(np.int64)


def draws(spark, sources: pd.DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(source_no, shard, first, n): the numbered draws of each source that a shard takes.

    Counts per shard are multinomial with the sources' shares; a source ends when its slots are used up, and
    what the draws leave short is made up in one last shard, so each source gets exactly its slots.
    """
    total = int(sources["slots"].sum())
    n_shards = -(-total // shard_slots)
    share = (sources["slots"] / max(total, 1)).to_numpy(float)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                slots = min(shard_slots, total - shard * shard_slots)
                n = np.random.default_rng([seed, shard]).multinomial(slots, share)
                some = np.flatnonzero(n)
                yield pd.DataFrame({"source_no": some, "shard": shard, "n": n[some]})

    drawn = spark.range(n_shards).mapInPandas(count, "source_no long, shard long, n long")
    limits = spark.createDataFrame(sources[["source_no", "slots", "blocks"]]) if len(sources) else spark.createDataFrame([], "source_no long, slots long, blocks long")
    last = limits.filter("slots > 0").select("source_no", F.lit(n_shards).cast("long").alias("shard"), F.col("slots").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source_no").orderBy("shard"))
    return (
        drawn.unionByName(last)
        .withColumn("upto", upto)
        .join(limits, "source_no")
        .withColumn("first", F.least(F.col("upto") - F.col("n"), "slots"))
        .withColumn("n", F.least("upto", "slots") - F.col("first"))
        .filter("n > 0")
        .select("source_no", "shard", "first", "n", "blocks")
        .repartition(max(n_shards // 16, int(spark.conf.get("spark.sql.shuffle.partitions"))), "source_no", "shard")
    )


def slots_of(drawn: DataFrame, seed: int) -> DataFrame:
    """(source_no, index, pass_no, shard): the block each draw takes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["n"].to_numpy()
            row = np.repeat(np.arange(len(batch)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            number = batch["first"].to_numpy()[row] + within
            blocks = batch["blocks"].to_numpy()[row]
            source = batch["source_no"].to_numpy()[row]
            pass_no = number // blocks
            key = mix64((np.uint64(seed) << np.uint64(40)) ^ (source.astype(np.uint64) << np.uint64(8)) ^ pass_no.astype(np.uint64))
            yield pd.DataFrame(
                {
                    "source_no": source,
                    "index": permuted(number % blocks, blocks, key),
                    "pass_no": pass_no,
                    "shard": batch["shard"].to_numpy()[row],
                }
            )

    return drawn.mapInPandas(giving_back(run), "source_no long, index long, pass_no long, shard long")


def placed(sized: DataFrame, sources: pd.DataFrame, seed: int) -> DataFrame:
    """Each row with its source's columns and ``start``, the words of the source before it.

    A source is walked in buckets of hashed ids, so no task holds a whole source; ``start`` is NULL for a
    document without words.
    """
    spark = sized.sparkSession
    n_buckets = min(buckets_for(sized.count(), BUCKET_DOCUMENTS), MOST_BUCKETS)
    known = spark.createDataFrame(sources[["source", "source_no", "source_size", "target"]], "source string, source_no long, source_size long, target double")
    hashed = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = (
        sized.join(known.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumns({"_hash": hashed, "_bucket": F.pmod(hashed, F.lit(n_buckets))})
    )
    keys = ["source_no", "_bucket"]
    inside = Window.partitionBy(*keys).orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys)
        .agg(F.sum("size").alias("_words"))
        .select(*keys, F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    )
    start = F.col("_offset") + F.coalesce(F.col("_inside"), F.lit(0))
    return (
        rows.withColumn("_inside", F.sum("size").over(inside))
        .join(offsets, keys)
        .withColumn("start", F.when(F.col("size") > 0, start))
        .drop("_hash", "_bucket", "_inside", "_offset")
    )


def pieces_of(rows: DataFrame, block: int) -> DataFrame:
    """(source_no, start, index, from_word, n_words): the part of each document in each block."""
    first = F.floor(F.col("start") / block)
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    lo = F.greatest(F.col("index") * block, "start")
    hi = F.least((F.col("index") + 1) * block, F.col("start") + F.col("size"))
    return (
        rows.filter("size > 0")
        .select("source_no", "start", "size", F.explode(F.sequence(first, last)).alias("index"))
        .select("source_no", "start", "index", (lo - F.col("start")).alias("from_word"), (hi - lo).alias("n_words"))
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    volume: float = VOLUME,
    most: float = MOST_REPEATS,
    block: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """The documents placed in their sources, and the pieces of them that the mix takes.

    ``docs`` has doc_id, source and size (words), and any other columns.  The first frame adds
    ``source_no, source_size, target, start``; the second is one row per taken piece: ``source_no,
    start, index, from_word, n_words, pass_no, shard``, where (source_no, start) names the document.

    A null source is a source of its own, last in order.  A document without words is placed nowhere and
    never taken.  Rows that repeat are documents of their own.  All draws follow ``seed`` and the rows, not
    their partitions, so runs agree.  An empty table gives empty frames.
    """
    sources = catalogue(docs, weights, volume, most, block)
    rows = placed(docs, sources, seed)
    drawn = draws(docs.sparkSession, sources, shard_slots, seed)
    # A draw becomes up to ``shard_slots`` rows, which the planner's estimate from the draws does not know: not to be broadcast.
    taken = pieces_of(rows, block).join(slots_of(drawn, seed).hint("merge"), ["source_no", "index"])
    return rows, taken


def taken_words(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``rows`` with ``taken``: the words the mix takes of each document, repeats counted."""
    sums = taken.groupBy("source_no", "start").agg(F.sum("n_words").alias("taken"))
    return rows.join(sums, ["source_no", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: one row for each document and pass that takes any of its words.

    A pass that takes a whole document repeats its text; of a pass that takes parts, runs of taken words
    keep their white space and are joined by a space.  Columns are those of ``docs``; ``text`` and, if
    there, ``n_chars`` are those of what was taken.
    """
    others = [c for c in docs.columns if c != "text"]
    # The row is nested, so that its names meet no names of the mix; the mix itself moves sizes, no texts.
    nested = F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")
    held = kept(docs.select(nested, "text", word_count().alias("size"), F.monotonically_increasing_id().alias("row_no")))
    rows, taken = mix(held.select("row.doc_id", "row.source", "size", "row_no"), **options)
    runs = taken.groupBy("source_no", "start", "pass_no").agg(
        F.sum("n_words").alias("words"), F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("runs")
    )
    passes = rows.join(runs, ["source_no", "start"]).select("row_no", "words", "runs")
    joined = held.join(passes, "row_no")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                text if words == size else taken_text(text, runs)
                for text, size, words, runs in zip(batch["text"], batch["size"], batch["words"], batch["runs"])
            ]
            yield pd.DataFrame({"mixed": out})

    done = map_rows(joined, cut, "mixed string", reads=["text", "size", "words", "runs"])
    made = {"text": F.col("mixed"), "n_chars": F.char_length("mixed").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return done.select(*[(made[c] if c in made else F.col("row").getField(c)).alias(c) for c in docs.columns])


def taken_text(text: str, runs) -> str:
    """The words of the runs, with the white space between neighbours."""
    import re

    ends = np.array([m.span() for m in re.finditer(WORD, text)])
    parts, lo, hi = [], None, None
    for run in runs:
        if run["from_word"] != hi:
            if hi is not None:
                parts.append(text[ends[lo, 0] : ends[hi - 1, 1]])
            lo = run["from_word"]
        hi = run["from_word"] + run["n_words"]
    parts.append(text[ends[lo, 0] : ends[hi - 1, 1]])
    return " ".join(parts)
