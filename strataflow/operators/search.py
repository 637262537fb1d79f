"""Keyword and vector search over report text."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import well_matches
from ..functions.predicates import in_dates
from .ordered import ranked_within, union_all


# Tasks get this module's classes with their code: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def keywords(text: str) -> list[str]:
    """Lower-case words of more than two characters."""
    return [w for w in text.lower().split() if len(w) > 2]


def search_docs(status: DataFrame, activities: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Summaries, then activity comments (then messages) as one searchable table."""
    parts = [
        status.select(
            F.lit(1).alias("source_no"), "well", "date", F.col("md_m").alias("depth_m"),
            F.lit("summary_24hr").alias("doc_type"), F.col("report_no").alias("doc_no"),
            F.col("summary_24hr").alias("text"),
        ),
        activities.filter(F.coalesce("comments", F.lit("")) != "").select(
            F.lit(2).alias("source_no"), "well", "date", "depth_m",
            F.concat("activity_code", F.lit(" activity")).alias("doc_type"), F.col("event_id").alias("doc_no"),
            F.col("comments").alias("text"),
        ),
    ]
    if messages is not None:
        parts.append(
            messages.select(
                F.lit(3).alias("source_no"), "well", F.col("message_type").alias("doc_type"),
                F.col("message_no").alias("doc_no"), F.col("message_text").alias("text"),
            )
        )
    return union_all(parts)


def keyword_search(
    docs: DataFrame,
    queries: Sequence[str],
    n: int = 10,
    well: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """First n documents per query: at most n of each source, summaries first.

    The queries are literals, so each text is read once and tested in place; no join.
    A query without a usable keyword matches every text.
    """
    docs = docs.filter(well_matches(F.col("well"), well))
    docs = docs.filter(in_dates(F.col("date"), date_from, date_to)) if date_from or date_to else docs
    lowered = F.lower("text")

    def hits(query: str) -> Column:
        words = keywords(query)
        if not words:
            return F.lit(0)
        return sum((lowered.contains(w).cast("int") for w in words[1:]), lowered.contains(words[0]).cast("int"))

    scored = F.array(
        *[
            F.when(
                (hits(q) > 0) if keywords(q) else F.lit(True),
                F.struct(F.lit(i).alias("query_no"), hits(q).alias("n_hits")),
            )
            for i, q in enumerate(queries)
        ]
    )
    found = docs.select("*", F.inline(F.array_compact(scored)))
    order = [F.asc_nulls_last("date"), F.asc("doc_no")]
    per_source = ranked_within(found, ["query_no", "source_no"], order, n, "_in_source")
    return ranked_within(
        per_source, ["query_no"], [F.asc("source_no"), F.asc("_in_source")], n
    ).drop("_in_source")


# Lengths of the pieces by which tokens are found; a word is found by pieces of the longest that it has room for.
GRAM_LENGTHS = (3, 4, 6)
# Pieces are told apart by so many numbers: lists of these are small however many pieces there are.
GRAM_NUMBERS = 1 << 20
# The white space of Unicode and the separators of ASCII, which Python splits by too.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def grams(text: Column, length: int) -> Column:
    """The pieces of ``length`` characters of a text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def gram_number(gram: Column) -> Column:
    """A number may stand for several pieces."""
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_NUMBERS)).cast("int")


def long_parts(lowered: Column) -> Column:
    """What blanks separate in a text, of more than two characters."""
    return F.filter(F.split(lowered, BLANK), lambda w: F.char_length(w) > 2)


def query_words(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """``query_id, word, times``: the lower-case words of more than two characters of each query."""
    words = long_parts(F.lower(F.col(text)))
    return queries.select(F.col(query_id).alias("query_id"), F.explode(words).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))


def tokens_with(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """``word, token``: the tokens (distinct) that hold each word (distinct).

    Of the longest pieces of a word the one whose tokens have the fewest characters gives its candidates, and only
    these are searched; a word with a piece in no token is in none.
    """
    room = F.when(F.lit(False), F.array().cast("array<string>"))
    for length in sorted(GRAM_LENGTHS, reverse=True):
        room = room.when(F.char_length("word") >= length, grams(F.col("word"), length))
    pieces = words.select("word", F.explode(F.array_distinct(room)).alias("gram"))
    every = F.array_distinct(F.concat(*[grams(F.col("token"), length) for length in GRAM_LENGTHS]))
    postings = tokens.select("token", F.explode(every).alias("gram"))

    # At most GRAM_NUMBERS rows of one number are broadcast.
    number = gram_number(F.col("gram"))
    numbers = F.broadcast(pieces.select(number.alias("number")).distinct())
    # Dealt by piece, so that counts and candidates share one exchange.
    wanted = postings.withColumn("number", number).join(numbers, "number", "left_semi").drop("number").repartition("gram")
    sizes = wanted.groupBy("gram").agg(F.sum(F.char_length("token")).alias("size"))
    met = pieces.join(sizes, "gram", "left").na.fill(0, ["size"])
    rarest = met.groupBy("word").agg(F.min(F.struct("size", "gram")).alias("best")).filter("best.size > 0").select("word", "best.gram")
    return wanted.join(rarest, "gram").filter(F.col("token").contains(F.col("word"))).select("word", "token")


def keyword_search_table(
    docs: DataFrame,
    queries: DataFrame,
    n: int = 10,
    query_id: str = "query_id",
    query_text: str = "query",
    well: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """``keyword_search`` for a table of queries of any size: ``query_id, n_hits``, the columns of ``docs``, ``rank_no``.

    No word holds a blank, so a text holds a word where one of its tokens, the parts between blanks, does.
    Each distinct token keeps its first n documents of each source, and words are looked for in the distinct
    tokens alone (``tokens_with``): no text is searched for a list.  Top lists are cut on narrow rows, the columns
    of the documents are joined to what is left.  A query without a usable keyword has the first
    documents of each source, which are found once.
    """
    docs = docs.filter(well_matches(F.col("well"), well))
    docs = docs.filter(in_dates(F.col("date"), date_from, date_to)) if date_from or date_to else docs
    # Equal rows have one key.
    keyed = docs.withColumn("_key", F.xxhash64(*docs.columns))
    order = [F.asc_nulls_last("date"), F.asc("doc_no"), F.asc("_key")]
    place = ["_key", "source_no", "date", "doc_no"]

    asked = query_words(queries, query_id, query_text)
    lowered = F.lower("text")
    spoken = keyed.select(*place, F.explode(F.array_distinct(long_parts(lowered))).alias("token"))
    # The first n texts of a query are among the first n of its words, and these among the first n of their tokens:
    # hits of what is common end here.
    listed = ranked_within(spoken, ["token", "source_no"], order, n, "_of_token").groupBy("token", *place).agg(F.count("*").alias("copies"))
    known = tokens_with(asked.select("word").distinct(), listed.select("token").distinct())
    # A text counts once, however many of its tokens hold the word.
    place_of_word = F.dense_rank().over(Window.partitionBy("word", "source_no").orderBy(*order))
    present = known.join(listed, "token").drop("token").withColumn("_of_word", place_of_word).filter(F.col("_of_word") <= n)
    present = present.groupBy("word", *place).agg(F.max("copies").alias("copies"))
    hits = present.join(asked, "word").groupBy("query_id", *place).agg(F.max("copies").alias("copies"))
    # Equal rows are places of their own, but no list holds more than n of them.
    hits = hits.select("query_id", *place, F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(n)).cast("int")))).drop("col")

    wordless = queries.select(F.col(query_id).alias("query_id")).join(asked.select("query_id"), "query_id", "left_anti")
    first = ranked_within(keyed.select(*place), ["source_no"], order, n, "_in_source").drop("_in_source")
    every = first.agg(F.collect_list(F.struct(*place))).scalar()  # n rows of each source
    hits = hits.unionByName(wordless.select("query_id", F.inline(every)))

    per_source = ranked_within(hits, ["query_id", "source_no"], order, n, "_in_source")
    best = ranked_within(per_source, ["query_id"], [F.asc("source_no"), F.asc("_in_source")], n)
    best = best.select("query_id", "rank_no", "_key")
    whole = keyed.join(best.select("_key"), "_key", "left_semi").dropDuplicates(["_key"]).withColumn("_lowered", lowered)
    lists = asked.groupBy("query_id").agg(F.collect_list(F.struct("word", "times")).alias("_words"))
    found = best.join(lists, "query_id", "left").join(whole, "_key")
    n_hits = F.aggregate(
        F.coalesce("_words", F.array().cast("array<struct<word:string,times:bigint>>")),
        F.lit(0),
        lambda total, w: total + F.when(F.col("_lowered").contains(w["word"]), w["times"].cast("int")).otherwise(0),
    )
    return found.select("query_id", n_hits.alias("n_hits"), *docs.columns, "rank_no")


def matrix_of(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of unit length; a zero vector stays zero."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64")
    rows = values.reshape(len(vectors), -1)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


class Nearest:
    """The k nearest of the vectors seen so far, for each query of a block."""

    def __init__(self, queries: pa.Array, vectors: pa.Array, k: int) -> None:
        self.queries, self.unit, self.k = queries, matrix_of(vectors), k
        self.edge = np.full(len(queries), -np.inf)
        self.query, self.cosine, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, ids: pa.Array, vectors: pa.Array) -> None:
        cosines = self.unit @ matrix_of(vectors).T
        if len(ids) > self.k and np.isinf(self.edge).any():
            self.edge = np.maximum(self.edge, np.partition(cosines, -self.k, axis=1)[:, -self.k])
        # Every row as close as the k-th stays, so that ties are settled by id.
        query, at = np.nonzero(cosines >= self.edge[:, None])
        self.query = np.concatenate([self.query, query])
        self.cosine = np.concatenate([self.cosine, cosines[query, at]])
        found = ids.take(pa.array(at))
        self.ids = found if self.ids is None else pa.concat_arrays([self.ids, found])
        order = np.lexsort((pc.rank(self.ids, "ascending", tiebreaker="dense").to_numpy(), -self.cosine, self.query))
        place = np.arange(len(order)) - np.searchsorted(self.query[order], self.query[order])
        order = order[place < self.k]
        self.query, self.cosine, self.ids = self.query[order], self.cosine[order], self.ids.take(pa.array(order))
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.edge[self.query[last]] = self.cosine[last]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.ids is not None:
            columns = [self.queries.take(pa.array(self.query)), self.ids, pa.array(self.cosine)]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "d", "cosine"])


def semantic_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    query_id: str = "query_id",
    vector: str = "embedding",
    well: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    group_vectors: int = 16_000,
    group_queries: int = 4_000,
) -> DataFrame:
    """Exact cosine top-k per query vector, over the documents of the wells and dates asked for.

    Documents are dealt into slices and queries into blocks of about ``group_vectors`` and ``group_queries`` rows,
    as many as their counts ask for; the counts are part of the plan.  A task holds the queries of a
    block, reads the documents of a slice batch by batch and keeps the k nearest of each query: its memory
    depends on the block alone.  Rows without an id or a vector take no part.
    """
    if well is not None:
        docs = docs.filter(well_matches(F.col("well"), well))
    if date_from is not None or date_to is not None:
        docs = docs.filter(in_dates(F.col("date"), date_from, date_to))

    def side(df: DataFrame, id_: str) -> DataFrame:
        return df.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")

    left, right = side(queries, query_id), side(docs, doc_id)
    blocks, slices = (
        df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size))).scalar().cast("int")
        for df, size in ((left, group_queries), (right, group_vectors))
    )

    def dealt(df: DataFrame, own: str, n_own: Column, other: str, n_other: Column, name: str, lacking: str, kind: str) -> DataFrame:
        return df.select(
            F.pmod(F.xxhash64("id", "v"), n_own).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), n_other - 1)).alias(other),
            F.lit(int(name == "d")).alias("side"),
            F.col("id").alias(name),
            F.lit(None).cast(kind).alias(lacking),
            "v",
        )

    kinds = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    asked = dealt(left, "block", blocks, "slice", slices, "q", "d", kinds[1])
    rows = asked.unionByName(dealt(right, "slice", slices, "block", blocks, "d", "q", kinds[0]))
    rows = rows.select("slice", "block", "side", "q", "d", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, best = None, [], None
        for batch in batches:
            at = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            turns = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *turns], [*turns, len(at)]):
                if lo == hi:
                    continue
                part, own = batch.slice(lo, hi - lo), (at[lo, 0], at[lo, 1])
                if own != group:
                    if best is not None:
                        yield from best.rows()
                    group, asked, best = own, [], None
                if not at[lo, 2]:
                    asked.append(part)
                elif asked:
                    if best is None:
                        held = pa.concat_batches(asked)
                        best = Nearest(held.column(3), held.column(5), k)
                    for i in range(0, part.num_rows, 1_000):
                        some = part.slice(i, 1_000)
                        best.add(some.column(4), some.column(5))
        if best is not None:
            yield from best.rows()

    # The queries of a group come before its documents.
    ordered = rows.repartition("slice", "block").sortWithinPartitions("slice", "block", "side")
    near = ordered.mapInArrow(run, f"q {kinds[0]}, d {kinds[1]}, cosine double")
    near = near.select(F.col("q").alias(query_id), F.col("d").alias(doc_id), "cosine")
    return ranked_within(near, [query_id], [F.desc("cosine"), F.asc(doc_id)], k).withColumn(
        "relevance", F.greatest(F.lit(0.0), F.col("cosine"))
    )


def search_with_fallback(docs: DataFrame, query: str, embed=None, k: int = 10, **filters) -> DataFrame:
    """Vector search where the table has embeddings and a query can be embedded, else keywords."""
    if "embedding" in docs.columns and embed is not None:
        one = docs.sparkSession.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("text"))
        return semantic_search(docs, one.withColumn("embedding", embed("text")), k, **filters)
    return keyword_search(docs, [query], k, **filters)
