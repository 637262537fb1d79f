"""Removing word passages that occur more than once, by seeds that are extended both ways.

Winnowed anchors seed the matches: documents meet on equal anchors (see ``segments``).  Where the surroundings
of an anchor differ between its places, matches are extended word by word to the left and to the
right as far as both agree; a match of at least ``length`` words is a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments as seg
from .common import buckets_for, kept, mix64, text_bytes
from .frames import map_rows

LENGTH = 35
GRAM = 8
BUCKET_BYTES = 16_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def hashed(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) for w in words], dtype=np.uint64)


def word_items(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    parts = [words_of(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return hashed([w for p in parts for w in p]), starts


def extended(contents: list[np.ndarray], anchor: np.ndarray, unit: np.ndarray, shape: seg.Shape) -> np.ndarray:
    """Which windows of each segment another segment of its unit has; (segments, choices) by window start.

    All segments of a unit hold its anchor, ``anchor`` words behind their start.  ``left[:, o]`` names the o words before the anchor and ``right[:, r]``
    the r words behind it, each built from the one before by one more word; two segments agree over a
    window that starts o words before the anchor if both names agree.
    """
    reach = shape.choices - 1
    size = np.array([len(c) for c in contents])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    flat = np.concatenate(contents)
    left = np.zeros((len(contents), reach + 1), np.uint64)
    right = np.zeros_like(left)
    for step in range(1, reach + 1):
        for name, at in ((left, anchor - step), (right, anchor + shape.gram - 1 + step)):
            inside = (at >= 0) & (at < size)
            word = flat[np.where(inside, first + at, 0)]
            name[:, step] = mix64(name[:, step - 1] * np.uint64(31) + word + np.uint64(step))
    out = np.zeros((len(contents), shape.choices), bool)
    for o in range(shape.choices):
        at = anchor - o
        whole = np.flatnonzero((at >= 0) & (at + shape.length <= size))
        if len(whole) < 2:
            continue
        name = mix64(left[whole, o] ^ (right[whole, reach - o] * np.uint64(3)) ^ mix64(unit[whole].view(np.uint64)))
        _, where, times = np.unique(name, return_inverse=True, return_counts=True)
        again = whole[times[where] > 1]
        out[again, at[again]] = True
    return out


def judge(shape: seg.Shape):
    """Leads of whole units to settled intervals."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        leads = frame.drop_duplicates(["unit", "seg"])
        contents = [np.frombuffer(c, dtype=np.uint64) for c in leads["content"]]
        hit = extended(contents, leads["at"].to_numpy(), leads["unit"].to_numpy(), shape)
        row, at = np.nonzero(hit)
        start = leads["start"].to_numpy()[row] + at
        doc = np.arange(len(leads))[row]
        return seg.settled_rows(leads["key1"].to_numpy(), leads["key2"].to_numpy(), doc, start, start + shape.length)[
            ["key1", "key2", "start", "stop"]
        ]

    return run


def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashed words of the segments asked for, each document split once."""
    for batch in batches:
        for key1, key2, text, asked in zip(batch["key1"], batch["key2"], batch["text"], batch["asked"]):
            words = words_of(text)
            yield pd.DataFrame(
                {
                    "key1": key1, "key2": key2,
                    "start": [a["start"] for a in asked],
                    "unit": [a["unit"] for a in asked],
                    "seg": [a["seg"] for a in asked],
                    "at": [a["at"] for a in asked],
                    "content": [hashed(words[a["start"] : a["stop"]]).tobytes() for a in asked],
                }
            )


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, unit_segments: int = seg.UNIT_SEGMENTS
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept``, text, if ``with_text``) per row.

    A word goes if it lies in ``length`` consecutive words whose sequence also starts anywhere else, in
    the same document or another; all places go alike, and windows are judged on the input.  Kept
    words are joined by one space.  A null, empty or blank text has no words.  Rows that repeat are
    documents of their own and so repeat each other; a null doc_id is as good as any.  An empty table
    gives no rows; other columns are not read.
    """
    rows = seg.keyed(docs.select("doc_id", "text"))
    shape = seg.Shape(length, gram, unit_segments)
    n_buckets = buckets_for(text_bytes(docs), BUCKET_BYTES)
    texts = rows.select("key1", "key2", "text")
    found = kept(seg.find(texts, word_items, shape, n_buckets, earlier=False))

    def fetched(kind: int) -> DataFrame:
        asked = (
            found.filter(F.col("kind") == kind)
            .groupBy("key1", "key2")
            .agg(F.collect_list(F.struct("start", "stop", "unit", "seg", "at")).alias("asked"))
        )
        return texts.join(asked, ["key1", "key2"]).mapInPandas(
            fetch, f"{seg.KEY}, start int, unit long, seg long, at int, content binary"
        )

    judged = (
        fetched(seg.LEAD)
        .groupBy(F.pmod(F.xxhash64("unit"), F.lit(64 * n_buckets)).alias("part"))
        .applyInPandas(judge(shape), f"{seg.KEY}, start int, stop int")
    )
    shared = seg.shared_windows(fetched(seg.HOT), shape, 8, n_buckets, earlier=False)
    settled = found.filter(F.col("kind") == seg.SETTLED).select("key1", "key2", "start", "stop")
    spans = seg.spans_of(settled.union(judged).union(shared))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, own in zip(batch["text"], batch["spans"]):
                words = words_of(text)
                gone = seg.covered(own, len(words))
                left = b" ".join([w for w, g in zip(words, gone) if not g])
                out.append((len(words), int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8") if with_text else None))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept"])

    added = "n_words long, n_removed long, kept_sha256 string, kept string"
    done = map_rows(rows.join(spans, ["key1", "key2"], "left"), run, added, reads=["text", "spans"])
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else []))
