import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strataflow.llm import multiset


def want_edited(rows):
    """doc_id -> edited text, for distinct ids."""
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        t, follows = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        out[i] = t[: len(t) - q] + follows[:q]
    return out


def test_edits_and_likeness(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = want_edited(list(texts.items()))
    rows = multiset.fingerprints(docs).collect()
    assert len(rows) == len(texts)
    prints = {}
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id] or "")
        assert r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    assert sum(r.near_edited for r in rows) > 5 * sum(r.near_next for r in rows)


def test_order_insertion_deletion(spark):
    df = spark.createDataFrame([("One line.\nTwo lines.\nThree.", "Three.\nOne line.\nTwo lines.", "Two lines.", "Three.\nOne line.")], "a string, b string, c string, d string")
    v = {c: multiset.vector_sum(multiset.elements(F.col(c))) for c in "abcd"}
    r = df.select(
        (v["a"] == v["b"]).alias("order"),
        (multiset.combined(v["a"], v["c"], -1) == v["d"]).alias("less"),
        (multiset.combined(v["d"], v["c"]) == v["a"]).alias("more"),
        (v["a"] == v["d"]).alias("same"),
    ).first()
    assert (r.order, r.less, r.more, r.same) == (True, True, True, False)


def test_odd_rows(spark, odd, nothing):
    rows = multiset.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert len([r for r in rows if r.doc_id is None]) == 1
    assert {r.n_chars for r in rows if r.doc_id in (2, 3)} == {0}
    assert all(r.edited_sha256 for r in rows)
    assert multiset.fingerprints(nothing).count() == 0
    one = multiset.fingerprints(odd.filter("doc_id = 7")).first()
    text = odd.filter("doc_id = 7").first().text
    assert one.edited_sha256 == hashlib.sha256(want_edited([(7, text)])[7].encode()).hexdigest()


def test_successors_over_many_ranges(spark):
    ids = [3, 5, 8, 13, 21, 34, 55, 89, 144]
    df = spark.createDataFrame([(i, i) for i in ids], "doc_id long, n_chars int")
    for range_ids in (1, 3, 100):
        got = {r.doc_id: r.next_id for r in multiset.successors(df, range_ids).collect()}
        assert got == dict(zip(ids, ids[1:] + ids[:1]))


def plain_vector(text):
    """Count and 64 words of a text, sentence by sentence."""
    parts = [p.strip(" ") for p in re.split(r"[\n\r]+|(?<=[.!?])\s+", text or "", flags=re.ASCII)]
    out = [0] * 65
    for p in filter(None, parts):
        seed = xxhash.xxh64_intdigest(hashlib.sha256(p.encode()).hexdigest(), 42)
        out[0] += 1
        for i in range(1, 65):
            out[i] = (out[i] + (xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed) & multiset.DIGITS)) % (1 << 60)
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = (np.array([((w >> 20 * lane) % (1 << 20) - 7.5 * v[0] + (1 << 19)) % (1 << 20) - (1 << 19) for lane in range(3) for w in v[1:]]) for v in (a, b))
    size = np.sqrt((x @ x) * (y @ y))
    return float(np.clip(x @ y / size, 0, 1)) if size else 0.0


def test_fingerprints_and_likeness_against_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts)
    follows = dict(zip(order, order[1:] + order[:1]))
    edited = want_edited(list(texts.items()))
    vectors = {i: plain_vector(t) for i, t in texts.items()}
    for r in multiset.fingerprints(docs).collect():
        own, other = vectors[r.doc_id], plain_vector(edited[r.doc_id])
        assert r.fingerprint == "".join(f"{w:015x}" for w in own)
        assert r.edited_fingerprint == "".join(f"{w:015x}" for w in other)
        assert abs(r.near_edited - plain_likeness(own, other)) < 1e-9
        assert abs(r.near_next - plain_likeness(own, vectors[follows[r.doc_id]])) < 1e-9


def test_numbers_at_the_ends_of_sentences_count_wherever_they_stand(spark):
    df = spark.createDataFrame([(1, "0 ab.\n1 cd 1. 2 ef "), (2, "2 ef\n0 ab.\n1 cd 1."), (3, "ab.\ncd 1. 2 ef")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in multiset.fingerprints(df).collect()}
    assert got[1] == got[2] != got[3]
