"""Homomorphic multiset fingerprints of texts, with built-in functions only.

A text is the multiset of its paragraphs; a paragraph counts sentence by sentence.  Each sentence is hashed
to a wide vector of small numbers, and a text's fingerprint is the sum of its vectors modulo powers of
two.  The sum does not depend on the order, and sentences are added or taken away without
the rest of the text.  Sums of texts that share most sentences point the same way, so the angle between
two fingerprints tells how alike the texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A word of the sum holds three lanes of 20 bits; each hashed sentence adds 0..15 to every lane.
WORDS = 64
LANE_BITS = 20
LANES = 3
LANE_MASK = (1 << LANE_BITS) - 1
WORD_MASK = (1 << (LANE_BITS * LANES)) - 1
DIGITS = sum(15 << (LANE_BITS * lane) for lane in range(LANES))
MEAN = 7.5
# Fixed value: sentences end at a line break, or at white space behind . ! or ?
SENTENCE_END = r"[\n\r]+|(?<=[.!?])\s+"
# Ids of a range of the table, which a task orders.
RANGE_IDS = 100_000


def elements(text: Column) -> Column:
    """Sentences of a text, trimmed, in order; none for a null, empty or blank text."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda p: F.btrim(p))
    return F.filter(parts, lambda p: p != "")


def vector_sum(parts: Column) -> Column:
    """Sum of the elements' vectors: their number, then WORDS words modulo 2**60."""
    digests = F.transform(parts, lambda p: F.sha2(p, 256))

    def added(total: Column, d: Column) -> Column:
        """One pass over the digests: whatever stands outside is worked out once."""

        def word(value: Column, i: Column) -> Column:
            step = F.when(i == 0, F.lit(1).cast("long")).otherwise(F.xxhash64(d, i).bitwiseAND(F.lit(DIGITS)))
            return (value + step).bitwiseAND(F.lit(WORD_MASK))

        return F.transform(total, word)

    return F.aggregate(digests, F.array_repeat(F.lit(0).cast("long"), WORDS + 1), added)


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the elements of both (``sign`` 1), or of ``a`` without those of ``b`` (-1)."""
    return F.zip_with(a, b, lambda x, y: (x + F.lit(sign) * y).bitwiseAND(F.lit(WORD_MASK)))


def as_text(vector: Column) -> Column:
    """Hexadecimal, 15 digits a word."""
    return F.array_join(F.transform(vector, lambda w: F.lower(F.lpad(F.hex(w), 15, "0"))), "")


def centred(vector: Column) -> Column:
    """Lanes less their expected sum; exact while the deviation stays below half a lane."""
    n = F.element_at(vector, 1)
    words = F.slice(vector, 2, WORDS)
    half = 1 << (LANE_BITS - 1)

    def lane(number: int) -> Column:
        return F.transform(
            words,
            lambda w: F.pmod(
                F.shiftright(w, LANE_BITS * number).bitwiseAND(F.lit(LANE_MASK)).cast("double") - n * F.lit(MEAN) + half,
                F.lit(float(1 << LANE_BITS)),
            )
            - half,
        )

    return F.concat(*[lane(i) for i in range(LANES)])


def product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def likeness(a: Column, b: Column, a_lanes: Column, b_lanes: Column) -> Column:
    """Cosine of two sums, from 0 to 1; 1 for equal fingerprints, 0 if only one has elements."""
    lengths = F.sqrt(product(a_lanes, a_lanes) * product(b_lanes, b_lanes))
    cosine = F.when(lengths > 0, product(a_lanes, b_lanes) / lengths).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)))


def last_not_above(edges: Column, value: Column, n: int) -> Column:
    """Position, from 0, of the last of ``n`` ascending edges that is not above the value; -1 if all are."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])

    def step(at: Column, jump: Column) -> Column:
        return F.when((at + jump <= n) & (F.get(edges, at + jump - 1) <= value), at + jump).otherwise(at)

    return F.aggregate(steps, F.lit(0), step) - 1


def successors(sized: DataFrame, range_ids: int = RANGE_IDS) -> DataFrame:
    """(doc_id, next_id, n_chars) per distinct id in ascending order; after the last comes the first.

    Ids are dealt into ranges of about ``range_ids`` that start at ids of the table.  The first id of a range is also
    shown, as a guest, to the range before it, so every range finds its successors alone.  Only the starts of
    the ranges come to the driver.
    """
    ids = sized.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    ranges = max(1, -(-sized.count() // range_ids))
    shares = [i / ranges for i in range(ranges)]
    starts = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * ranges)).alias("s"), F.min("doc_id").alias("m")).first()
    cuts = sorted({*(starts["s"] or []), *([starts["m"]] if starts["m"] is not None else [])})
    edges = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    place = last_not_above(edges, F.col("doc_id"), len(cuts))
    before = F.pmod(F.col("place") - 1, F.lit(max(len(cuts), 1)))
    homes = F.when(
        F.get(edges, F.col("place")) == F.col("doc_id"),
        F.array(F.struct(F.col("place").alias("home"), F.lit(0).alias("guest")), F.struct(before.alias("home"), F.lit(1).alias("guest"))),
    ).otherwise(F.array(F.struct(F.col("place").alias("home"), F.lit(0).alias("guest"))))
    shown = ids.withColumn("place", place).select("doc_id", "n_chars", F.inline(homes))
    order = Window.partitionBy("home").orderBy("guest", "doc_id")
    return shown.withColumn("next_id", F.lead("doc_id").over(order)).filter("guest = 0").select("doc_id", "next_id", "n_chars")


def edited(docs: DataFrame) -> DataFrame:
    """Each document with its edited text and its neighbour's fingerprint.

    Adds ``n_chars, edited, next_vector``: the last quarter of the code points (rounded down) gives way
    to as many of the next document, ascending doc_id, or all it has.  Rows with one doc_id have
    the same next document; of several rows with the next id the smallest text is taken.  Rows
    without doc_id follow all others' order as if their id were the smallest.
    """
    text = F.coalesce("text", F.lit(""))
    no_id = F.lit(-(1 << 63)).cast("long")
    # Both joins read these two columns and nothing else, so they share one exchange of the texts.
    clean = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("key"), text.alias("text"))
    sized = clean.select(F.col("key").alias("doc_id"), F.char_length("text").alias("n_chars"))
    links = successors(sized).select(
        F.col("next_id").alias("key"), F.col("doc_id").alias("for_key"), F.floor(F.col("n_chars") / 4).cast("int").alias("most")
    )
    # Heads of the next texts travel to the documents that end in them; the longest quarter of an id is enough.
    heads = (
        clean.select("key", "text")
        .join(links, "key")
        .select("for_key", F.struct(F.left("text", "most").alias("head"), vector_sum(elements(F.col("text"))).alias("next_vector"), F.col("text")).alias("n"))
        .select("for_key", F.struct("n.head", "n.next_vector").alias("n"))
        .groupBy("for_key")
        .agg(F.min("n").alias("n"))
        .select(F.col("for_key").alias("key"), "n.head", "n.next_vector")
    )
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    return (
        clean.join(heads, "key", "left")
        .withColumn("n_chars", n.cast("long"))
        .withColumn("edited", F.concat(F.left("text", n - quarter), F.left("head", quarter)))
        .withColumn("doc_id", F.nullif("key", no_id).cast(docs.schema["doc_id"].dataType))
        .drop("key", "head")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row.

    A null text is empty; texts without sentences have fingerprints of zeros.  Repeated rows are returned
    each.  An empty table gives no rows; other columns are not read.
    """
    rows = edited(docs.select("doc_id", "text"))
    vectors = rows.withColumn("v", vector_sum(elements(F.col("text")))).withColumn("e", vector_sum(elements(F.col("edited"))))
    lanes = vectors.withColumns({"vl": centred(F.col("v")), "el": centred(F.col("e")), "nl": centred(F.col("next_vector"))})
    return lanes.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("v")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("e"), F.col("vl"), F.col("el")).alias("near_edited"),
        likeness(F.col("v"), F.col("next_vector"), F.col("vl"), F.col("nl")).alias("near_next"),
    )
