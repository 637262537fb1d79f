"""Removing byte strings that an earlier document has, by suffix arrays of what documents share.

Segments (see ``segments``) bring together the places that can hold equal strings; the suffix array of each
unit of different segments tells which strings are equal.  It is built by grouping: suffixes
are grouped by their longest Lyndon prefix, then each group's order follows from the suffixes behind those
prefixes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments as seg
from .common import buckets_for, kept, mix64, text_bytes
from .frames import map_rows

LENGTH = 50
GRAM = 20
BUCKET_BYTES = 8_000_000
TEXT_SYMBOLS = 1 << 16

BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[list[int]]]:
    """Suffixes grouped by longest Lyndon prefix: previous smaller suffixes, and the groups in ascending order.

    Groups start as first symbols and are processed from the largest down.  The previous smaller suffix of a
    member is found by pointers that skip all that has been processed; it takes the member's prefix
    onto its own and so moves to a new group right above its old one, further up the more
    members point to it.
    """
    n = len(text)
    if not n:
        return [], []
    first: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        first.setdefault(symbol, []).append(i)
    keys = sorted(first)
    members = [first[k] for k in keys]
    of = [0] * n
    for g, m in enumerate(members):
        for i in m:
            of[i] = g
    size = [len(m) for m in members]
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    above[-1] = -1
    done = bytearray(n + 1)  # at -1 stands what is never processed
    pointer = [0] * n
    order = []
    g = len(members) - 1
    while g >= 0:
        group = members[g]
        if len(group) == 1:
            i = group[0]
            if of[i] == g:
                order.append(g)
                done[i] = 1
                p = i - 1
                while done[p]:
                    p = pointer[p]
                pointer[i] = p
                if p >= 0:
                    old = of[p]
                    if size[old] > 1:  # alone in its group, it stays where it is
                        size[old] -= 1
                        of[p] = new = len(members)
                        members.append([p])
                        size.append(1)
                        up = above[old]
                        above.append(up)
                        below.append(old)
                        above[old] = new
                        if up >= 0:
                            below[up] = new
            g = below[g]
            continue
        group = sorted([i for i in group if of[i] == g])
        if group:
            members[g] = group
            order.append(g)
            for i in group:
                done[i] = 1
            targets = []
            for i in group:
                p = i - 1
                while done[p]:
                    p = pointer[p]
                pointer[i] = p
                if p >= 0:
                    targets.append(p)
            times = Counter(targets)
            if len(times) == len(targets):
                levels = [targets]
            else:
                levels = [[] for _ in range(max(times.values()))]
                for p, k in times.items():
                    levels[len(levels) - k].append(p)
            for level in levels:
                fresh: dict[int, int] = {}
                for p in level:
                    old = of[p]
                    new = fresh.get(old)
                    if new is None:
                        if size[old] == 1:
                            continue
                        new = fresh[old] = len(members)
                        members.append([])
                        size.append(0)
                        up = above[old]
                        above.append(up)
                        below.append(old)
                        above[old] = new
                        if up >= 0:
                            below[up] = new
                    members[new].append(p)
                    of[p] = new
                    size[old] -= 1
                    size[new] += 1
        g = below[g]
    order.reverse()
    return pointer, [members[g] for g in order]


def suffix_array(text: Sequence[int]) -> list[int]:
    """Suffixes of ``text`` in order; a suffix that is a prefix of another comes first.

    Second step of the grouping construction: suffixes of one group differ only behind their common
    Lyndon prefix, where the next smaller suffix starts.  Going through the array in order, each
    suffix puts those that have it behind their prefix into the next free places of their groups.
    """
    n = len(text)
    previous, groups = lyndon_groups(text)
    group_of, free, at = [0] * n, [], 0
    for position, group in enumerate(groups):
        for i in group:
            group_of[i] = position
        free.append(at)
        at += len(group)
    out = [0] * n
    # First the suffixes with nothing smaller behind them but the end.
    j = n - 1
    while j >= 0:
        g = group_of[j]
        out[free[g]] = j
        free[g] += 1
        j = previous[j]
    for position in range(n):
        # Those whose Lyndon prefix ends right before i: i - 1 and its previous smaller ones, down to i's own group.
        i = out[position]
        least = group_of[i]
        j = i - 1
        while j >= 0:
            g = group_of[j]
            if g < least:
                break
            out[free[g]] = j
            free[g] += 1
            j = previous[j]
    return out


def byte_items(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return BYTE_VALUE[np.frombuffer(b"".join(parts), dtype=np.uint8)], starts


def earlier_windows(contents: list[np.ndarray], unit: np.ndarray, owners: np.ndarray, at: np.ndarray, length: int, gram: int):
    """(segment, start) of the windows that a segment of the same unit with a smaller owner also has.

    Each segment is written with one symbol for its unit's anchor, which all segments of the unit have and
    every window holds, so that windows of different units differ; symbol 0 ends a segment.
    """
    written, sizes = [], []
    for number, (content, place) in enumerate(zip(contents, at)):
        text = np.empty(len(content) - gram + 2, dtype=np.int64)
        text[:place] = content[:place]
        text[place + 1 : -1] = content[place + gram :]
        text[:-1] += 1
        text[place], text[-1] = 257 + unit[number], 0
        written.append(text)
        sizes.append(len(text))
    flat = np.concatenate(written)
    starts = np.cumsum(sizes) - sizes
    order = np.array(suffix_array(flat.tolist()), dtype=np.int64)
    of = np.searchsorted(starts, order, "right") - 1
    inside = order - starts[of]
    reach = length - gram + 1
    valid = (inside <= at[of]) & (inside + reach < np.array(sizes)[of])
    order, of, inside = order[valid], of[valid], inside[valid]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = np.arange(reach)
    window = flat[order[:, None] + span]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (window[1:] != window[:-1]).any(axis=1)
    first = np.minimum.reduceat(owners[of], np.flatnonzero(fresh))
    found = first[np.cumsum(fresh) - 1] < owners[of]
    return of[found], inside[found]


def judge(length: int, gram: int):
    """Units of different segments to settled intervals: for leads and for followers of the same segment."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        leads = frame[(frame["kind"] == seg.LEAD) & frame["content"].notna()]
        leads = leads.drop_duplicates(["unit", "seg", "key1", "key2"]).sort_values("unit", kind="stable")
        units = leads["unit"].to_numpy()
        fresh = np.ones(len(units), bool)
        fresh[1:] = units[1:] != units[:-1]
        number = np.cumsum(fresh) - 1
        contents = [np.frombuffer(c, dtype=np.uint8) for c in leads["content"]]
        owners, at = leads["key1"].to_numpy(), leads["at"].to_numpy()
        found_segment, found_start = [], []
        # Whole units are written into texts of about TEXT_SYMBOLS symbols.
        edges, held = [0], 0
        for i, content in enumerate(contents):
            if fresh[i] and held > TEXT_SYMBOLS:
                edges.append(i)
                held = 0
            held += len(content) - gram + 2
        edges.append(len(contents))
        for lo, hi in zip(edges, edges[1:]):
            if hi - lo > 1:
                segment, start = earlier_windows(contents[lo:hi], number[lo:hi] - number[lo], owners[lo:hi], at[lo:hi], length, gram)
                found_segment.append(segment + lo)
                found_start.append(start)
        empty = pd.DataFrame({"key1": np.zeros(0, np.int64), "key2": np.zeros(0, np.int64), "start": np.zeros(0, np.int32), "stop": np.zeros(0, np.int32)})
        if not found_segment:
            return empty
        segment, start = np.concatenate(found_segment), np.concatenate(found_start)
        if not len(segment):
            return empty
        order = np.lexsort((start, segment))
        segment, start = segment[order], start[order]
        turn = np.ones(len(segment), bool)
        turn[1:] = (segment[1:] != segment[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(turn)
        last = np.concatenate([first[1:], [len(segment)]]).astype(np.int64) - 1
        verdict = pd.DataFrame(
            {"unit": units[segment[first]], "seg": leads["seg"].to_numpy()[segment[first]], "from_": start[first], "to": start[last] + length}
        ).drop_duplicates()
        hit = frame[["unit", "seg", "key1", "key2", "start"]].merge(verdict, on=["unit", "seg"])
        return pd.DataFrame(
            {"key1": hit["key1"], "key2": hit["key2"], "start": (hit["start"] + hit["from_"]).astype(np.int32), "stop": (hit["start"] + hit["to"]).astype(np.int32)}
        )

    return run


def repeated_spans(docs: DataFrame, length: int, gram: int, unit_segments: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with keys, and (key1, key2, spans): intervals of bytes to remove, of documents that have any."""
    rows = seg.keyed(docs)
    shape = seg.Shape(length, gram, unit_segments)
    n_buckets = buckets_for(text_bytes(docs), BUCKET_BYTES)
    # A null id is neither smaller nor larger than another: such rows neither lose nor take anything.
    texts = rows.filter(F.col("doc_id").isNotNull()).select("key1", "key2", "text")
    found = kept(seg.find(texts, byte_items, shape, n_buckets, earlier=True))
    asked = found.filter(F.col("kind") != seg.SETTLED)
    content = F.when(
        F.col("kind").isin(seg.LEAD, seg.HOT),
        F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("stop") - F.col("start")),
    )
    fetched = asked.join(texts, ["key1", "key2"]).select("kind", "key1", "key2", "start", "unit", "seg", "at", content.alias("content"))
    judged = (
        fetched.filter(F.col("kind") != seg.HOT)
        .groupBy(F.pmod(F.xxhash64("unit"), F.lit(64 * n_buckets)).alias("part"))
        .applyInPandas(judge(length, gram), f"{seg.KEY}, start int, stop int")
    )
    settled = found.filter(F.col("kind") == seg.SETTLED).select("key1", "key2", "start", "stop")
    shared = seg.shared_windows(fetched.filter(F.col("kind") == seg.HOT), shape, 1, n_buckets, earlier=True)
    return rows, seg.spans_of(settled.union(judged).union(shared))


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, unit_segments: int = seg.UNIT_SEGMENTS
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, bytes, if ``with_text``) per row.

    A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller
    doc_id; strings are judged on the input.  A null text is empty.  Rows with one doc_id are equals:
    neither is earlier.  A row without doc_id keeps all its bytes and takes none.  An empty table gives no
    rows; other columns are not read.
    """
    base = docs.select("doc_id", "text")
    rows, spans = repeated_spans(base, length, gram, unit_segments)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, own in zip(batch["text"], batch["spans"]):
                raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
                gone = seg.covered(own, len(raw))
                left = raw[~gone].tobytes()
                n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                out.append((len(raw), int(gone.sum()), n_spans, hashlib.sha256(left).hexdigest(), left if with_text else None))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    added = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    done = map_rows(rows.join(spans, ["key1", "key2"], "left"), run, added, reads=["text", "spans"])
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
