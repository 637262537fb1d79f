import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataflow.llm import repeats, suffix
from strataflow.llm import segments as seg


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 97, 98, 99, 255]), max_size=60))
def test_suffix_array(values):
    text = bytes(values)
    assert suffix.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_groups_share_lyndon_prefixes():
    text = b"banananab\0abab"
    _, groups = suffix.lyndon_groups(text)
    flat = [i for g in groups for i in g]
    assert sorted(flat) == list(range(len(text)))

    def lyndon(i):
        return max((text[i:j] for j in range(i + 1, len(text) + 1) if all(text[i:j] < text[k:j] for k in range(i + 1, j))), key=len)

    for g in groups:
        assert len({lyndon(i) for i in g}) == 1
    assert [lyndon(g[0]) for g in groups] == sorted({lyndon(i) for i in range(len(text))})


def brute_bytes(rows, length):
    """(doc_id, text) -> (n_bytes, n_removed, n_spans, sha) per row."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - length + 1):
                s = b[k : k + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def brute_words(rows, length):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    times = Counter(tuple(w[k : k + length]) for _, w in texts for k in range(len(w) - length + 1))
    out = []
    for i, w in texts:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - length + 1):
            if times[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = True
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(left).hexdigest()))
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_bytes_against_brute_force(spark, odd, sf, which):
    docs = odd if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 4000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = suffix.remove_repeats(docs).collect()
    assert in_order(got) == in_order(brute_bytes(rows, 50))
    assert any(r.n_removed for r in got)


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_words_against_brute_force(spark, odd, sf, which):
    docs = odd if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = repeats.remove_repeats(docs).collect()
    assert in_order(got) == in_order(brute_words(rows, 35))
    assert any(r.n_removed for r in got)


def common_line(spark, n):
    """One passage in all documents, each with surroundings of its own."""
    line = "the one very common line that stands in all of these documents and never changes at all"
    return spark.createDataFrame([(i, f"before {i * 7919} x{i} {line} y{i} behind {i * 104729}") for i in range(n)], "doc_id long, text string")


@pytest.mark.parametrize("times", [1, 2])
def test_hot_anchors_are_judged_by_window(spark, times):
    """Anchors with more segments than a unit may hold, also where rows repeat."""
    docs = common_line(spark, 120)
    docs = docs.union(docs) if times > 1 else docs
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert in_order(suffix.remove_repeats(docs, unit_segments=16).collect()) == in_order(brute_bytes(rows, 50))
    assert in_order(repeats.remove_repeats(docs, length=12, gram=4, unit_segments=16).collect()) == in_order(brute_words(rows, 12))


def found_rows(spark, n):
    docs = seg.keyed(common_line(spark, n)).select("key1", "key2", "text")
    return seg.find(docs, suffix.byte_items, seg.Shape(50, 20, 16), 4, earlier=True).count()


def test_work_on_a_hot_anchor_grows_with_its_segments(spark):
    assert found_rows(spark, 4_000) < 5 * found_rows(spark, 1_000)


def test_segments_whose_short_hashes_meet():
    """Equal segments stay together although another one has the same first 32 bits of hash."""
    shape = seg.Shape(10, 4)
    rows = np.zeros(3, seg.SEGMENT)
    rows["anchor"], rows["seg"], rows["more"], rows["doc"] = 7, 9, [1, 2, 1], [0, 1, 2]
    names = np.array([[i, i] for i in range(3)], np.int64)
    payload = np.int64(3).tobytes() + names.tobytes() + rows.tobytes()
    got = seg.meet(shape, 1, True)(pd.DataFrame({"bucket": [0], "kind": np.int8([0]), "payload": [payload]}))
    assert got.loc[got["kind"] == seg.SETTLED, "key1"].tolist() == [2]


def test_shared_anchors_without_a_repeat(spark):
    """Passages shorter than a window bring segments together that share none: all texts stay."""
    rows = [(i, f"{i * 7919} {i}{i} a passage of thirty bytes or so {i * 104729} {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.remove_repeats(docs).collect()
    assert in_order(got) == in_order(brute_bytes(rows, 50)) and not any(r.n_removed for r in got)
    got = repeats.remove_repeats(docs).collect()
    assert in_order(got) == in_order(brute_words(rows, 35)) and not any(r.n_removed for r in got)


def test_texts_that_are_kept(spark, odd, nothing):
    got = {r.doc_id: r for r in suffix.remove_repeats(odd, with_text=True).collect() if r.doc_id != 12}
    assert bytes(got[6].kept) == b"" and len(got[5].kept) == got[5].n_bytes
    assert repeats.remove_repeats(odd, with_text=True).filter("doc_id = 6").first().kept == ""
    assert suffix.remove_repeats(nothing).count() == 0 and repeats.remove_repeats(nothing).count() == 0


def test_segments_cover_every_window():
    rng = np.random.default_rng(1)
    shape = seg.Shape(10, 4)
    items = rng.integers(0, 3, 500).astype(np.uint64) * np.uint64(7919)
    starts = np.array([0, 5, 5, 300, 500])
    found = shape.segments(items, starts)
    anchor, doc, start, extra = (found[c] for c in ("anchor", "doc", "start", "extra"))
    assert (found["at"] >= extra).all() and (found["at"] <= shape.choices - 1).all()
    covered = {(d, s + k) for d, s, e in zip(doc, start, extra) for k in range(e + 1)}
    assert covered == {(d, k) for d in range(4) for k in range(starts[d + 1] - starts[d] - 9)}
    by_window = {}
    for a, d, s, e in zip(anchor, doc, start, extra):
        for k in range(e + 1):
            w = items[starts[d] + s + k : starts[d] + s + k + 10].tobytes()
            assert by_window.setdefault(w, a) == a


@pytest.mark.parametrize("earlier", [True, False])
def test_windows_of_hot_segments_travel_packed(spark, monkeypatch, earlier):
    rng = np.random.default_rng(3)
    shape = seg.Shape(6, 3)
    places = pd.DataFrame(
        [(int(rng.integers(0, 40)), i % 3, 10 * i, bytes(rng.integers(97, 99, rng.integers(6, 11)).astype(np.uint8))) for i in range(600)],
        columns=["key1", "key2", "start", "content"],
    )
    want, owners = set(), {}
    for key1, _, _, c in places.itertuples(index=False):
        for k in range(len(c) - 5):
            owners.setdefault(c[k : k + 6], []).append(key1)
    for key1, key2, start, c in places.itertuples(index=False):
        for k in range(len(c) - 5):
            own = owners[c[k : k + 6]]
            if (key1 > min(own)) if earlier else len(own) > 1:
                want |= {(key1, key2, x) for x in range(start + k, start + k + 6)}
    monkeypatch.setattr(seg, "HOT_WINDOWS", 200)
    sent = list(seg.name_windows(shape, 1, 4, earlier)(places.iloc[lo : lo + 100] for lo in range(0, 600, 100)))
    assert sum(map(len, sent)) <= 6 * 5  # one row per bucket and chunk, not one per window
    packed = pd.concat(sent)
    found = pd.concat([seg.meet_windows(6, earlier)(part) for _, part in packed.groupby("bucket")])
    assert {(r.key1, r.key2, x) for r in found.itertuples() for x in range(r.start, r.stop)} == want
