"""Finding strings of fixed length that occur more than once, without listing every string.

Every window of ``length`` items (bytes or words) holds an anchor: its k-gram of smallest hash, the leftmost on
ties.  Neighbouring windows with the same anchor form a segment.  Equal windows have equal
anchors, so whatever has to be compared lies in one anchor's group.  Segments travel as
packed arrays, one row per bucket of anchors and batch of documents.

* Equal segments are found by hash.  Copies inside a batch are settled there, so a passage that
  half the documents share sends one segment per batch.
* Different segments of one anchor can still share windows; only those are asked for by content.  The
  segments of an anchor are a unit and compared together, unless they are many (an edge of a passage that
  very many documents share): then every window is hashed and counted, which is linear in the segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

SEGMENT = np.dtype(
    [("anchor", "<u4"), ("seg", "<u4"), ("more", "<u2"), ("start", "<u4"), ("doc", "<u2"), ("extra", "u1"), ("at", "u1"), ("many", "?"), ("near", "u1", 3)]
)
CHUNK_ITEMS = 1 << 21
STEP_ITEMS = 1 << 17
UNIT_SEGMENTS = 1_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

# A document is named by key1 (its id) and key2 (a hash of id and text), so rows with one id are told apart.
KEY = "key1 long, key2 long"
FOUND = f"kind byte, {KEY}, start int, stop int, unit long, seg long, at int"
SETTLED, LEAD, FOLLOWER, HOT = 0, 1, 2, 3


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with key1 and key2, which are never null."""
    return docs.withColumns(
        {
            "key1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")),
            "key2": F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"),
        }
    )


@dataclass
class Shape:
    """Windows of ``length`` items with anchors of ``gram`` items."""

    length: int
    gram: int
    unit_segments: int = UNIT_SEGMENTS

    @property
    def choices(self) -> int:
        return self.length - self.gram + 1

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_powers") or len(self._powers[0]) < n:
            size = max(n, STEP_ITEMS + 1)
            up = np.full(size, BASE, dtype=np.uint64)
            down = np.full(size, INVERSE, dtype=np.uint64)
            up[0] = down[0] = 1
            self._powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self._powers[0][:n], self._powers[1][:n]

    def segments(self, items: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Of concatenated documents, per segment: hash of the anchor and of the segment, document, start
        in it, items beyond ``length``, place of the anchor in the segment, and ``near``.

        ``items`` are 64-bit values; document d is items[starts[d]:starts[d + 1]].  ``near`` are small
        hashes of what stands left of the anchor, around it and right of it, each two thirds of a window's
        reach: two segments that share a window agree in at least one.
        """
        n = len(items)
        n_windows = n - self.length + 1
        if n_windows <= 0:
            empty = np.zeros(0, np.int64)
            return {"anchor": empty.view(np.uint64), "seg": empty.view(np.uint64), "doc": empty, "start": empty, "extra": empty, "at": empty, "near": np.zeros((0, 3), np.uint8)}
        up, down = self.powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(items * up[:n], out=sums[1:])
        gram = mix64((sums[self.gram :] - sums[: -self.gram]) * down[: n - self.gram + 1])
        # The low bits hold the position: a minimum of values is then an argument of the minimum.
        bits = np.uint64(max(24, int(n).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        best = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
        span = 1
        while span * 2 <= self.choices:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if span < self.choices:
            best = np.minimum(best[: span - self.choices], best[self.choices - span :])
        # Windows that run over the end of their document are none.
        whole = np.ones(n_windows, bool)
        for end in starts[1:-1]:
            whole[max(0, end - self.length + 1) : end] = False
        turn = np.ones(n_windows, bool)
        turn[1:] = (best[1:] != best[:-1]) | (whole[1:] != whole[:-1])
        turn[starts[1:-1][starts[1:-1] < n_windows]] = True
        first = np.flatnonzero(turn)
        last = np.concatenate([first[1:], [n_windows]]) - 1
        used = whole[first]
        first, last = first[used], last[used]
        anchor_at = (best[first] & low).astype(np.int64)
        doc = np.searchsorted(starts, first, "right") - 1
        stop = last + self.length

        def hashed(lo, hi):
            return mix64((sums[hi] - sums[lo]) * down[lo])

        reach = self.choices - 1
        third, behind = reach // 3, anchor_at + self.gram
        near = [
            hashed(np.maximum(anchor_at - (reach - third), 0), anchor_at),
            hashed(np.maximum(anchor_at - third, 0), np.minimum(behind + third, n)),
            hashed(behind, np.minimum(behind + (reach - third), n)),
        ]
        return {
            "anchor": gram[anchor_at],
            "seg": mix64((sums[stop] - sums[first]) * down[first] + mix64((stop - first).astype(np.uint64))),
            "doc": doc,
            "start": first - starts[doc],
            "extra": stop - first - self.length,
            "at": anchor_at - first,
            "near": np.stack([(h >> np.uint64(40)).astype(np.uint8) for h in near], axis=1),
        }


def batches_of(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``most`` characters; a longer document is a run of its own."""
    lo, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes)


def settled_rows(key1, key2, doc, start, stop) -> pd.DataFrame:
    """Settled intervals with touching ones of a document joined."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    turn = np.ones(len(doc), bool)
    turn[1:] = (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
    first = np.flatnonzero(turn)
    # Segments of a document all have length or more items and start in order, so stops rise as well.
    stops = np.maximum.reduceat(stop, first) if len(first) else stop
    doc, start = doc[first], start[first]
    return pd.DataFrame(
        {"kind": np.int8(SETTLED), "key1": key1[doc], "key2": key2[doc], "start": start.astype(np.int32), "stop": stops.astype(np.int32), "unit": np.int64(0), "seg": np.int64(0), "at": np.int32(0)}
    )


def cut(items_of: Callable, shape: Shape, n_buckets: int, earlier: bool):
    """Batches of (key1, key2, text) to rows (bucket, kind, payload).

    ``items_of(texts)`` gives concatenated 64-bit items and starts.  ``earlier``: a copy counts only
    if a document with a smaller key1 has it; else any second occurrence counts.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["text"].str.len().fillna(0).to_numpy(dtype=np.int64)
            for lo, hi in batches_of(sizes, CHUNK_ITEMS):
                part = frame.iloc[lo:hi].sort_values("key1", kind="stable")
                key1, key2 = part["key1"].to_numpy(), part["key2"].to_numpy()
                texts = part["text"].tolist()
                found = []
                # Small steps: the arrays of one step stay in the processor's cache.
                for a, b in batches_of([len(t or "") for t in texts], STEP_ITEMS):
                    step = shape.segments(*items_of(texts[a:b]))
                    step["doc"] = step["doc"] + a
                    found.append(step)
                anchor, seg, doc, start, extra, place, near = (
                    np.concatenate([f[c] for f in found]) for c in ("anchor", "seg", "doc", "start", "extra", "at", "near")
                )
                if not len(anchor):
                    continue
                both = mix64(anchor ^ (seg * BASE))
                order = np.argsort(both, kind="stable")  # documents stay in order of key1
                head = np.ones(len(order), bool)
                head[1:] = both[order][1:] != both[order][:-1]
                group = np.cumsum(head) - 1
                size = np.bincount(group)[group]
                if earlier:
                    gone = key1[doc[order]] > key1[doc[order[head]]][group]
                    goes = ~gone
                else:
                    gone = size > 1
                    goes = head
                if gone.any():
                    at = order[gone]
                    rows = settled_rows(key1, key2, doc[at], start[at], start[at] + extra[at] + shape.length)
                    payload = rows[["key1", "key2", "start", "stop"]].to_records(index=False).tobytes()
                    yield pd.DataFrame({"bucket": [int(part["key2"].iloc[0]) % n_buckets], "kind": np.int8([1]), "payload": [payload]})
                at = order[goes]
                bucket = (anchor[at] >> np.uint64(32)) % np.uint64(n_buckets)
                out = np.empty(len(at), SEGMENT)
                out["anchor"], out["start"] = anchor[at] & np.uint64(0xFFFFFFFF), start[at]
                out["seg"], out["more"] = seg[at] & np.uint64(0xFFFFFFFF), (seg[at] >> np.uint64(32)) & np.uint64(0xFFFF)
                out["extra"], out["at"], out["many"], out["near"] = extra[at], place[at], size[goes] > 1, near[at]
                # Only documents with a whole window have segments: fewer than 2**16 of a batch.
                local = doc[at]
                by = np.argsort(bucket.astype(np.uint16 if n_buckets < 1 << 16 else np.uint64), kind="stable")
                out, local = out[by], local[by]
                dealt = bucket[by].astype(np.int64)
                first = np.flatnonzero(np.diff(dealt, prepend=-1))
                names = np.stack([key1, key2], axis=1)
                payloads = []
                for lo, hi in zip(first, [*first[1:], len(dealt)]):
                    rows = out[lo:hi]
                    docs_here, rows["doc"] = np.unique(local[lo:hi], return_inverse=True)
                    payloads.append(np.int64(len(docs_here)).tobytes() + names[docs_here].tobytes() + rows.tobytes())
                buckets = dealt[first]
                yield pd.DataFrame({"bucket": buckets, "kind": np.zeros(len(buckets), np.int8), "payload": payloads})

    return run


def meet(shape: Shape, n_buckets: int, earlier: bool):
    """All payloads of a bucket to FOUND rows: settled intervals, and segments to be compared by content.

    Of equal segments one occurrence is the lead, whose content is fetched; followers wait for its verdict.
    Segments of an anchor with more than ``unit_segments`` leads are HOT and belong to no unit.
    """
    settled_type = np.dtype([("key1", "<i8"), ("key2", "<i8"), ("start", "<i4"), ("stop", "<i4")])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        done = [np.frombuffer(p, settled_type) for p in frame.loc[frame["kind"] == 1, "payload"]]
        outs = [
            pd.DataFrame({"kind": np.int8(SETTLED), **{c: d[c] for c in settled_type.names}, "unit": np.int64(0), "seg": np.int64(0), "at": np.int32(0)})
            for d in done
        ]
        names, rows, docs, base = [], [], [], 0
        for payload in frame.loc[frame["kind"] == 0, "payload"]:
            n = int(np.frombuffer(payload, np.int64, 1)[0])
            names.append(np.frombuffer(payload, np.int64, 2 * n, offset=8).reshape(n, 2))
            part = np.frombuffer(payload, SEGMENT, offset=8 + 16 * n)
            docs.append(part["doc"].astype(np.int64) + base)
            base += n
            rows.append(part)
        if rows:
            outs += compare(np.concatenate(names), np.concatenate(rows), np.concatenate(docs), int(frame["bucket"].iloc[0]))
        return pd.concat(outs, ignore_index=True)

    def compare(names: np.ndarray, rows: np.ndarray, doc: np.ndarray, bucket: int) -> list[pd.DataFrame]:
        key1, key2 = names[:, 0], names[:, 1]
        anchor, seg = rows["anchor"].astype(np.uint64), rows["seg"].astype(np.uint64)
        seg_id = (seg << np.uint64(16)) | rows["more"]
        key = (anchor << np.uint64(32)) | seg
        order = np.argsort(key)
        sorted_key, sorted_id = key[order], seg_id[order]
        if ((sorted_key[1:] == sorted_key[:-1]) & (sorted_id[1:] != sorted_id[:-1])).any():
            # Rare: 32 bits of the hashes of two segments agree.
            order = np.lexsort((seg_id, key))
            sorted_key, sorted_id = key[order], seg_id[order]
        head = np.ones(len(order), bool)
        head[1:] = (sorted_key[1:] != sorted_key[:-1]) | (sorted_id[1:] != sorted_id[:-1])
        top = np.ones(len(order), bool)
        top[1:] = sorted_key[1:] >> np.uint64(32) != sorted_key[:-1] >> np.uint64(32)
        heads, tops = np.flatnonzero(head), np.flatnonzero(top)
        segment, group = np.cumsum(head) - 1, np.cumsum(top) - 1
        own = key1[doc[order]]
        kinds = np.bincount(group[heads])  # different segments of each anchor
        if earlier:
            least = np.minimum.reduceat(own, heads)
            settled = own > least[segment]
            several = (kinds > 1) & (np.maximum.reduceat(own, tops) > np.minimum.reduceat(own, tops))
        else:
            settled = (np.add.reduceat(rows["many"][order].astype(np.int64), heads) + np.bincount(segment) > 1)[segment]
            several = kinds > 1
        outs = []
        if settled.any():
            s = order[settled]
            start = rows["start"][s].astype(np.int64)
            outs.append(settled_rows(key1, key2, doc[s], start, start + rows["extra"][s] + shape.length))
        # A segment is compared if another of its anchor may share a window with it.
        near = rows["near"][order[heads]]
        asked = np.flatnonzero(several[group[heads]])
        alike = np.zeros(len(heads), bool)
        for side in range(3):
            value = group[heads[asked]] * 256 + near[asked, side]
            _, where, times = np.unique(value, return_inverse=True, return_counts=True)
            alike[asked] |= times[where] > 1
        # Of each such segment one occurrence is the lead: for ``earlier`` one of the smallest document.
        open_ = np.flatnonzero(alike[segment] & (~settled if earlier else head))
        if len(open_):
            lead = np.ones(len(open_), bool)
            lead[1:] = segment[open_][1:] != segment[open_][:-1]
            g = group[open_]
            hot = np.bincount(g[lead], minlength=len(kinds))[g] > shape.unit_segments
            at = order[open_]
            unit = mix64((np.uint64(bucket) << np.uint64(32)) ^ anchor[at])
            start = rows["start"][at].astype(np.int32)
            outs.append(
                pd.DataFrame(
                    {
                        "kind": np.where(hot, HOT, np.where(lead, LEAD, FOLLOWER)).astype(np.int8),
                        "key1": key1[doc[at]],
                        "key2": key2[doc[at]],
                        "start": start,
                        "stop": start + rows["extra"][at].astype(np.int32) + np.int32(shape.length),
                        "unit": unit.view(np.int64),
                        "seg": seg_id[at].view(np.int64),
                        "at": rows["at"][at].astype(np.int32),
                    }
                )
            )
        if not outs:
            none = np.zeros(0, np.int64)
            outs.append(settled_rows(none, none, none, none, none))
        return outs

    return run


def find(docs: DataFrame, items_of: Callable, shape: Shape, n_buckets: int, earlier: bool) -> DataFrame:
    """FOUND rows of ``docs`` (key1, key2, text)."""
    cuts = docs.select("key1", "key2", "text").mapInPandas(cut(items_of, shape, n_buckets, earlier), "bucket int, kind byte, payload binary")
    return cuts.groupBy("bucket").applyInPandas(meet(shape, n_buckets, earlier), FOUND)


WINDOW = np.dtype([("high", "<u8"), ("low", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("many", "?")])
HOT_WINDOWS = 1 << 18


def name_windows(shape: Shape, width: int, n_buckets: int, earlier: bool):
    """Batches of (key1, key2, start, content) to rows (bucket, kind, payload), as ``cut`` does with segments.

    What a chunk's own places settle is settled here, and of equal windows one is sent.
    """
    size = shape.length * width

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append(frame)
            n += sum(map(len, frame["content"])) // width - len(frame) * (shape.length - 1)
            if n > HOT_WINDOWS:
                yield from packed(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if held:
            yield from packed(pd.concat(held, ignore_index=True))

    def packed(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        contents = [bytes(c) for c in frame["content"]]
        times = np.array([(len(c) - size) // width + 1 for c in contents], dtype=np.int64)
        of = np.repeat(np.arange(len(contents)), times)
        if not len(of):
            return
        shift = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        names = b"".join([xxh3_128_digest(contents[i][k * width : k * width + size]) for i, k in zip(of.tolist(), shift.tolist())])
        high, low = np.frombuffer(names, "<u8").reshape(-1, 2).T
        key1, key2 = frame["key1"].to_numpy()[of], frame["key2"].to_numpy()[of]
        start = frame["start"].to_numpy(dtype=np.int64)[of] + shift
        order = np.lexsort((key1, low, high))
        high, low, key1, key2, start = high[order], low[order], key1[order], key2[order], start[order]
        head = np.ones(len(order), bool)
        head[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        group = np.cumsum(head) - 1
        # Keys come in order: the first of a window has the smallest.  A window of that very key stays, it may lose to another chunk.
        many = np.bincount(group)[group] > 1
        gone = key1 > key1[head][group] if earlier else many
        if gone.any():
            payload = settled_places(key1[gone], key2[gone], start[gone], shape.length)
            yield pd.DataFrame({"bucket": [int(high[0] % np.uint64(n_buckets))], "kind": np.int8([1]), "payload": [payload]})
        goes = ~gone if earlier else head
        bucket = (high[goes] >> np.uint64(8)) % np.uint64(n_buckets)
        by = np.argsort(bucket, kind="stable")
        out = np.empty(len(by), WINDOW)
        out["high"], out["low"], out["start"], out["many"] = high[goes][by], low[goes][by], start[goes][by], many[goes][by]
        key = np.stack([key1[goes][by], key2[goes][by]], axis=1)
        dealt = bucket[by].astype(np.int64)
        first = np.flatnonzero(np.diff(dealt, prepend=-1))
        payloads = []
        for lo, hi in zip(first, [*first[1:], len(dealt)]):
            rows = out[lo:hi]
            docs, where = np.unique(key[lo:hi], axis=0, return_inverse=True)
            rows["doc"] = where.ravel()
            payloads.append(np.int64(len(docs)).tobytes() + docs.tobytes() + rows.tobytes())
        yield pd.DataFrame({"bucket": dealt[first], "kind": np.zeros(len(first), np.int8), "payload": payloads})

    return run


def settled_places(key1, key2, start, length: int) -> bytes:
    """Places of windows as packed intervals, touching ones of a document joined."""
    docs, doc = np.unique(np.stack([key1, key2], axis=1), axis=0, return_inverse=True)
    rows = settled_rows(docs[:, 0], docs[:, 1], doc.ravel(), start, start + length)
    return rows[["key1", "key2", "start", "stop"]].to_records(index=False).tobytes()


def meet_windows(length: int, earlier: bool):
    """All payloads of a bucket to settled intervals."""
    settled_type = np.dtype([("key1", "<i8"), ("key2", "<i8"), ("start", "<i4"), ("stop", "<i4")])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        done = [np.frombuffer(p, settled_type) for p in frame.loc[frame["kind"] == 1, "payload"]]
        rows, key1, key2 = [], [], []
        for payload in frame.loc[frame["kind"] == 0, "payload"]:
            n = int(np.frombuffer(payload, np.int64, 1)[0])
            names = np.frombuffer(payload, np.int64, 2 * n, offset=8).reshape(n, 2)
            part = np.frombuffer(payload, WINDOW, offset=8 + 16 * n)
            rows.append(part)
            key1.append(names[part["doc"], 0])
            key2.append(names[part["doc"], 1])
        if rows:
            window, key1, key2 = np.concatenate(rows), np.concatenate(key1), np.concatenate(key2)
            order = np.lexsort((key1, window["low"], window["high"]))
            window, key1, key2 = window[order], key1[order], key2[order]
            head = np.ones(len(order), bool)
            head[1:] = (window["high"][1:] != window["high"][:-1]) | (window["low"][1:] != window["low"][:-1])
            group = np.cumsum(head) - 1
            if earlier:
                gone = key1 > key1[head][group]
            else:
                gone = (np.bincount(group) + np.bincount(group, window["many"]) > 1)[group]
            if gone.any():
                payload = settled_places(key1[gone], key2[gone], window["start"][gone].astype(np.int64), length)
                done.append(np.frombuffer(payload, settled_type))
        return pd.DataFrame(np.concatenate(done) if done else np.zeros(0, settled_type))

    return run


def shared_windows(places: DataFrame, shape: Shape, width: int, n_buckets: int, earlier: bool) -> DataFrame:
    """(key1, key2, start, stop) of the windows that several of ``places`` have, for ``earlier`` those of larger key1.

    ``places`` (key1, key2, start, content) are segments whose items take ``width`` bytes each.  A window is named by
    128 bits of hash.  Windows travel packed, one row per bucket of names and chunk; of equal windows of a chunk one
    goes on (for ``earlier`` those of its smallest key), so a window that very many places have is a few entries a chunk.
    """
    named = places.select("key1", "key2", "start", "content").mapInPandas(
        name_windows(shape, width, n_buckets, earlier), "bucket int, kind byte, payload binary"
    )
    return named.groupBy("bucket").applyInPandas(meet_windows(shape.length, earlier), f"{KEY}, start int, stop int")


def spans_of(found: DataFrame) -> DataFrame:
    """(key1, key2, spans): sorted intervals of each document; as many as its text allows."""
    return found.groupBy("key1", "key2").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def covered(spans, n: int) -> np.ndarray:
    """Which of n items lie in any of the spans."""
    steps = np.zeros(n + 1, dtype=np.int32)
    if spans is not None and len(spans):
        np.add.at(steps, [s["start"] for s in spans], 1)
        np.add.at(steps, [s["stop"] for s in spans], -1)
    return np.cumsum(steps[:n]) > 0
