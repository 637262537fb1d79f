"""How far the vocabularies of sources lie apart, by chunk factorization.

Texts are cut at white space and their chunks counted, document by document; only distinct chunks are
tokenized, once, and their terms joined back to the counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept


def marks(of: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(of, dtype=np.uint8))


# A chunk is cut by ASCII white space, a term holds letters of ASCII and all beyond ASCII.
CHUNK_BYTES = ~marks(b"\t\n\v\f\r ")
TERM_BYTES = marks(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
# A task works on so many bytes, rows or pairs at once; that bounds its memory, not the counts.
MOST_BYTES = 24 << 20
MOST_ROWS = 200_000
MOST_PAIRS = 2_000_000
MOST_HELD = 300_000
# Stand for the documents of a chunk that is in three or more.
ENOUGH = (-1, -2, -3)


def numbered_groups(docs: DataFrame) -> DataFrame:
    """``lang, source, no``: the groups, numbered from 0 within a language."""
    order = Window.partitionBy("lang").orderBy("source")
    return docs.select("lang", "source").distinct().withColumn("no", (F.row_number().over(order) - 1).cast("int"))


def lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def runs_of(texts: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The longest runs of bytes that ``inside`` marks, text after text, and the text each comes from."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    marked = inside[data]
    begins = marked.copy()
    begins[1:] &= ~marked[:-1]
    # A text begins a run of its own even where the one before ends inside one.
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = marked[heads]
    finish = marked.copy()
    finish[:-1] &= ~marked[1:] | begins[1:]
    at = np.flatnonzero(begins)
    ends = np.cumsum(np.append(0, np.flatnonzero(finish) + 1 - at)).astype(np.int32)
    runs = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data[marked])])
    return runs, np.searchsorted(offsets, at, side="right") - 1


def whole_runs(batches: Iterator[pa.RecordBatch], by: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows in larger batches that end where the columns ``by`` change."""
    waiting, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        size += batch.num_rows
        last = int(np.flatnonzero(changes(*(batch.column(i) for i in by)))[-1])
        # The rows of the last key may go on in the next batch.
        if last and size > most:
            rows, cut = pa.concat_batches(waiting), size - batch.num_rows + last
            yield rows.slice(0, cut)
            waiting, size = [rows.slice(cut)], size - cut
    if waiting:
        yield pa.concat_batches(waiting)


def chunk_counts(docs: DataFrame) -> DataFrame:
    """``lang, chunk, docs, low, high, nos, ns`` of rows with lang, no and text, per task and its runs of rows.

    ``nos`` and ``ns`` hold the groups and their occurrences.  A document is a row and is read by one
    task; ``docs`` counts to 3, and up to two documents are named by ``low`` and ``high``.
    """

    def counted(rows: pa.RecordBatch, first: int):
        chunks, doc = runs_of(rows.column(2), CHUNK_BYTES)
        if not len(chunks):
            return
        coded, langs = chunks.dictionary_encode(), rows.column(0).dictionary_encode()
        lang, no = langs.indices.to_numpy().astype(np.int64), rows.column(1).to_numpy().astype(np.int64)
        # Documents in the order of their groups: one sort brings chunks, languages, groups and documents together.
        order = np.lexsort((no, lang))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        joint = np.sort(coded.indices.to_numpy().astype(np.int64) * len(order) + rank[doc])
        at = np.flatnonzero(np.diff(joint, prepend=-1))
        times = np.diff(np.append(at, len(joint)))
        code, doc = joint[at] // len(order), order[joint[at] % len(order)]
        key, no = code * len(langs.dictionary) + lang[doc], no[doc]
        per_key = np.flatnonzero(np.diff(key, prepend=-1))
        per_group = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(no, prepend=-1) != 0))
        total, no = np.add.reduceat(times, per_group), no[per_group]
        found = np.diff(np.append(per_key, len(key)))
        named = found < len(ENOUGH)
        low = np.where(named, np.minimum.reduceat(doc, per_key) + first, 0)
        high = np.where(named, np.maximum.reduceat(doc, per_key) + first, 0)
        key = key[per_key]
        ends = np.append(np.searchsorted(per_group, per_key), len(no))
        for i in range(0, len(key), 10_000):
            j = min(i + 10_000, len(key))
            a, b = ends[i], ends[j]
            columns = [
                langs.dictionary.take(pa.array(key[i:j] % len(langs.dictionary))),
                coded.dictionary.take(pa.array(key[i:j] // len(langs.dictionary))),
                pa.array(np.minimum(found[i:j], len(ENOUGH)).astype(np.int32)),
                pa.array(low[i:j]),
                pa.array(high[i:j]),
                lists(no[a:b], ends[i:j] - a, pa.int32()),
                lists(total[a:b], ends[i:j] - a, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "chunk", "docs", "low", "high", "nos", "ns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, waiting, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            size += batch.column(2).nbytes
            if size > MOST_BYTES:
                rows = pa.concat_batches(waiting)
                yield from counted(rows, first)
                first, waiting, size = first + rows.num_rows, [], 0
        if waiting:
            yield from counted(pa.concat_batches(waiting), first)

    schema = "lang string, chunk string, docs int, low long, high long, nos array<int>, ns array<long>"
    return docs.select("lang", "no", "text").mapInArrow(run, schema)


def changes(*columns: pa.Array) -> np.ndarray:
    """Whether a row of a sorted batch differs from the one before; the first row does."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = False
    for column in columns:
        out[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs that start at ``starts``, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def summed(key: np.ndarray, no: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums per key and group, in that order."""
    width = int(no.max(initial=0)) + 1
    joint = key * width + no
    order = np.argsort(joint, kind="stable")
    joint = joint[order]
    at = np.flatnonzero(np.diff(joint, prepend=-1))
    return joint[at] // width, joint[at] % width, np.add.reduceat(n[order], at) if len(at) else n


def named(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to three distinct documents per key."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[fresh], doc[fresh]
    first = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, np.arange(len(key)), 0))
    few = np.arange(len(key)) - first < len(ENOUGH)
    return key[few], doc[few]


def term_rows(counts, docs, names, least_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows of all keys in ``least_docs`` documents, from keys with groups and occurrences and keys with documents.

    ``names`` gives languages and terms of keys.
    """
    key, no, n = summed(*counts)
    doc_key, doc = named(*docs)
    # Every key has groups and documents, so the runs of both are in step.
    start, doc_start = (np.flatnonzero(np.diff(k, prepend=-1)) for k in (key, doc_key))
    groups, documents = np.diff(np.append(start, len(key))), np.diff(np.append(doc_start, len(doc_key)))
    keep = np.flatnonzero(documents >= least_docs)
    for i in range(0, len(keep), 10_000):
        some = keep[i : i + 10_000]
        docs_at, at = ranges(doc_start[some], documents[some]), ranges(start[some], groups[some])
        columns = [
            *names(key[start[some]]),
            lists(doc[docs_at], np.cumsum(documents[some]) - documents[some], pa.int64()),
            lists(no[at], np.cumsum(groups[some]) - groups[some], pa.int32()),
            lists(n[at], np.cumsum(groups[some]) - groups[some], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "seen", "nos", "ns"])


TERMS = "lang string, term string, seen array<long>, nos array<int>, ns array<long>"


def with_terms(chunks: DataFrame) -> DataFrame:
    """``lang, term, seen, nos, ns``: rows of one chunk meet, it is tokenized once, and its terms take their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, [1], MOST_ROWS):
            fresh = changes(rows.column(1))
            tokens, of = runs_of(pc.ascii_lower(rows.column(1).filter(pa.array(fresh))), TERM_BYTES)
            if not len(tokens):
                continue
            coded, langs = tokens.dictionary_encode(), rows.column(0).dictionary_encode()
            # Rows by the terms of their chunk, a repeated term as often as it occurs.
            sizes = np.bincount(of, minlength=fresh.sum())
            of_chunk = np.cumsum(fresh) - 1
            row = np.repeat(np.arange(rows.num_rows), sizes[of_chunk])
            token = coded.indices.to_numpy().astype(np.int64)[ranges((np.cumsum(sizes) - sizes)[of_chunk], sizes[of_chunk])]
            width = len(langs.dictionary)
            key = token * width + langs.indices.to_numpy()[row]
            # These by the groups of the row.
            lengths = rows.column(5).value_lengths().to_numpy().astype(np.int64)
            nos, ns = (rows.column(i).flatten().to_numpy().astype(np.int64) for i in (5, 6))
            at = ranges((np.cumsum(lengths) - lengths)[row], lengths[row])
            docs, low, high = (rows.column(i).to_numpy()[row].astype(np.int64) for i in (2, 3, 4))
            many = docs >= len(ENOUGH)
            doc_keys = np.concatenate([key[~many], key[~many], *[key[many]] * len(ENOUGH)])
            seen = np.concatenate([low[~many], high[~many], *[np.full(many.sum(), mark) for mark in ENOUGH]])
            yield from term_rows(
                (np.repeat(key, lengths[row]), nos[at], ns[at]),
                (doc_keys, seen),
                lambda keys: (langs.dictionary.take(pa.array(keys % width)), coded.dictionary.take(pa.array(keys // width))),
                0,
            )

    return chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, TERMS)


def merged_terms(terms: DataFrame, min_docs: int) -> DataFrame:
    """One row per language and term in ``min_docs`` documents: ``lang, term, nos, ns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, [0, 1], MOST_ROWS):
            fresh = changes(rows.column(0), rows.column(1))
            key, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            seen, groups = (rows.column(i).value_lengths().to_numpy() for i in (2, 3))
            nos, ns = (rows.column(i).flatten().to_numpy().astype(np.int64) for i in (3, 4))
            yield from term_rows(
                (np.repeat(key, groups), nos, ns),
                (np.repeat(key, seen), rows.column(2).flatten().to_numpy()),
                lambda keys: tuple(rows.column(i).take(pa.array(first[keys])) for i in (0, 1)),
                min_docs,
            )

    return terms.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, TERMS).drop("seen")


def vocabulary(docs: DataFrame, min_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """Groups and kept terms of a table with text, lang and source.

    Groups: ``lang, source, no, size, terms, lang_size``, sizes counting kept terms and ``terms`` being their
    number; kept terms: ``lang, term, nos, ns``, the groups that hold it and its occurrences.  The list of
    groups may be broadcast: the audit has a row for any two of a language, so it is a root of the result.
    """
    if min_docs > len(ENOUGH):
        raise ValueError("documents are told apart up to three")
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = kept(numbered_groups(docs))
    chunks = chunk_counts(docs.join(F.broadcast(groups), ["lang", "source"]))
    terms = kept(merged_terms(with_terms(chunks), min_docs))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    sizes = occurrences(terms).groupBy("lang", "no").agg(F.sum("n").alias("size"))
    lang_sizes = sizes.groupBy("lang").agg(F.sum("size").alias("lang_size"))
    sized = groups.join(sizes, ["lang", "no"], "left").join(langs, "lang", "left").join(lang_sizes, "lang", "left")
    return kept(sized.na.fill(0, ["size", "terms", "lang_size"])), terms


def occurrences(terms: DataFrame) -> DataFrame:
    """``lang, term, total, no, n``: a row per term and group that holds it."""
    total = F.aggregate("ns", F.lit(0).cast("long"), lambda a, b: a + b)
    return terms.select("lang", "term", total.alias("total"), F.explode(F.arrays_zip("nos", "ns")).alias("at")).select(
        "lang", "term", "total", F.col("at.nos").alias("no"), F.col("at.ns").alias("n")
    )


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * (count+1) / whole) of longs, by long division in base 1000."""
    rest, out = counts + 1, np.zeros(len(counts), dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def both_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value``: over the terms that both groups hold, what the excess differs by from that of
    terms of one alone, so that it can be added to sums over each group's own terms.

    Groups meet inside the row of a term; a task hands on one sum per pair.
    """
    sizes = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "size"))), lambda x: x["size"]).alias("sizes"), F.max("terms").alias("terms"))
    rows = terms.filter(F.size("nos") > 1).join(F.broadcast(sizes), "lang")
    size = F.transform("nos", lambda no: F.get("sizes", no) + F.col("terms"))
    # The list of a language's groups is not carried by every term: only the sizes of the groups that hold it.
    rows = rows.select("lang", "nos", "ns", size.alias("wholes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], int] = defaultdict(int)

        def add(lang, no, p, p0):
            """Matrices: a row per term, a column per group that holds it."""
            k = no.shape[1]
            step = max(1, MOST_PAIRS // k)
            for left in range(0, k, step):
                a = slice(left, left + step)
                some = max(1, MOST_PAIRS // (k * min(k, step)))
                for top in range(0, len(no), some):
                    t = slice(top, top + some)
                    pa_, pa0 = p[t, a, None], p0[t, a, None]
                    pb, pb0 = p[t, None, :], p0[t, None, :]
                    value = (pa_ - pb) ** 2 // pb - (pa_ - pb0) ** 2 // pb0 - (pa0 - pb) ** 2 // pb + (pa0 - pb0) ** 2 // pb0
                    pair = (no[t, a, None] << 32) + no[t, None, :]
                    keys, at = np.unique(pair.ravel(), return_inverse=True)
                    total = np.zeros(len(keys), dtype=np.int64)
                    np.add.at(total, at, value.ravel())
                    for key, v in zip(keys.tolist(), total.tolist()):
                        sums[lang, key >> 32, key & 0xFFFFFFFF] += v

        def flush():
            rows = [(*key, value) for key, value in sums.items() if key[1] != key[2]]
            sums.clear()
            for i in range(0, len(rows), 10_000):
                columns = list(zip(*rows[i : i + 10_000]))
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "a", "b", "value"])

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            no, n, whole = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (1, 2, 3))
            held = np.asarray(batch.column(1).value_lengths())
            starts = np.cumsum(held) - held
            p, p0 = shares(n, whole), shares(np.zeros(len(n), dtype=np.int64), whole)
            for lang in set(langs):
                for k in np.unique(held[langs == lang]):
                    at = starts[(langs == lang) & (held == k)][:, None] + np.arange(k)
                    add(lang, no[at], p[at], p0[at])
            if len(sums) > MOST_HELD:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def share(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(1e9 * (count+1) / (size+terms)) of longs, by long division in base 1000."""
    whole, rest, out = size + terms, count + F.lit(1).cast("long"), F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + F.call_function("div", rest, whole)
        rest = rest % whole
    return out + 1


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def pair_values(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the excesses of a source over another of its language, over all terms.

    Terms that neither source holds have one excess, terms of one source only an excess by count: both
    follow from the numbers of terms by count.  Only terms of both are met with each other.
    """
    zero, number = F.lit(0), F.col("terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("item_no"), F.col("size").alias("item_size"))
    pairs = groups.join(other, "lang").filter("no != item_no")
    has = pairs.filter("terms > 0")
    p0, q0 = share(zero, F.col("size"), number), share(zero, F.col("item_size"), number)
    a, b = F.col("no").alias("a"), F.col("item_no").alias("b")
    constant = has.select("lang", a, b, (number * excess(p0, q0)).alias("value"))
    times = occurrences(terms).groupBy("lang", "no", "n").agg(F.count("*").alias("times"))
    met = times.join(has, ["lang", "no"])
    mine = share(F.col("n"), F.col("size"), number)
    as_group = met.select("lang", a, b, (F.col("times") * (excess(mine, q0) - excess(p0, q0))).alias("value"))
    as_item = met.select(
        "lang", F.col("item_no").alias("a"), F.col("no").alias("b"), (F.col("times") * (excess(q0, mine) - excess(q0, p0))).alias("value")
    )
    summed = constant.unionByName(as_group).unionByName(as_item).unionByName(both_values(terms, groups))
    summed = summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    every = pairs.select("lang", a, b, "source", "item")
    return every.join(summed, ["lang", "a", "b"], "left").na.fill(0, ["value"]).select("lang", "source", "item", "value")


def term_values(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the terms of a source that are likelier there than in its language."""
    met = occurrences(terms).join(F.broadcast(groups), ["lang", "no"])
    p = share(F.col("n"), F.col("size"), F.col("terms"))
    q = share(F.col("total"), F.col("lang_size"), F.col("terms"))
    met = met.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    return met.select("lang", "source", "item", excess(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: sources by distance, and the terms that mark a source.

    Null text, lang and source count as empty.  A row is a document, so repeated rows and repeated or null
    ids count each; whole texts are read.  Equal values are ranked by item in the order of UTF-8.  A
    language without a kept term gives its pairs the value 0; a source alone in its language gives no pair.  An
    empty table gives no rows; other columns are not read.
    """
    groups, kept_terms = vocabulary(docs, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, kept_terms).withColumn("rank", F.row_number().over(order))
    terms = term_values(groups, kept_terms).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_terms)

    def part(df, name):
        return df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")

    return part(pairs, "pair").unionByName(part(terms, "term"))
