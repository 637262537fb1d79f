import re

import numpy as np
from pyspark.sql import functions as F

from strataflow.llm import pii


def plain(text):
    """Leftmost matches, as the patterns stand."""
    good = []
    for number, (kind, pattern) in enumerate(zip(pii.KINDS, (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE))):
        good += [(number, m.start(), m.end()) for m in re.finditer(pattern, text) if pii.passes(kind, m[0])]
    return good


def test_skipping_search_equals_plain_search():
    rng = np.random.default_rng(0)
    pieces = ["a@b.c", "_d@e.f", "1.2.3.4", ".5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", " ", "x", "@", ".", "12", "\n", "é", "a@b", "-", "a.b@c-d.e.f"]
    for _ in range(400):
        text = "".join(rng.choice(pieces, rng.integers(1, 12)))
        assert sorted(pii.matches(text)[0]) == sorted(plain(text)), text


def test_checks():
    assert pii.passes("card", "4111 1111 1111 1111") and not pii.passes("card", "4111 1111 1111 1112")
    assert pii.passes("ip", "255.0.0.001") and not pii.passes("ip", "256.0.0.1")
    assert pii.passes("phone", "+1 (555) 123-4567") and not pii.passes("phone", "+1 555")


def test_gradients():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger(1)
    for lstm in (tagger.forth, tagger.back):
        lstm.x, lstm.h = lstm.x.astype(float), lstm.h.astype(float)
    tagger.out, tagger.bias, tagger.move = (p.astype(float) for p in (tagger.out, tagger.bias, tagger.move))
    classes, tags = rng.integers(0, pii.N_CLASSES, (7, 3)), rng.integers(0, pii.N_TAGS, (7, 3))
    _, grads = tagger.loss(classes, tags)
    for p, g in zip(tagger.parameters(), grads):
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in p.shape)
            old, step = p[at], 1e-2
            p[at] = old + step
            up = tagger.loss(classes, tags)[0]
            p[at] = old - step
            down = tagger.loss(classes, tags)[0]
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-3


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    tagger = pii.Tagger(3)
    tagger.move[:] = rng.normal(size=tagger.move.shape)
    classes = rng.integers(0, pii.N_CLASSES, (3, 4))
    e = tagger.emissions(classes)[0]
    got = tagger.decode(classes)
    for row in range(4):
        best = max(np.ndindex(*(pii.N_TAGS,) * 3), key=lambda p: sum(e[t, row, p[t]] for t in range(3)) + sum(tagger.move[p[t - 1], p[t]] for t in (1, 2)))
        assert tuple(got[:, row]) == best


def test_held_out_agreement(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    tagger = pii.train(docs.filter("doc_id % 2 = 0"))
    texts = [r.text for r in docs.filter("doc_id % 2 = 1").collect() if r.text and pii.MARKS.search(r.text)]
    right = every = 0
    for text in texts:
        numbers, classes = pii.windows(text)
        found = set(pii.reconcile(numbers, tagger.decode(classes.T).T, len(text)))
        base = pii.matches(text)[0]
        right += sum(any(k == b and s < e2 and s2 < e for b, s2, e2 in found) for k, s, e in base)
        every += len(base)
    assert every > 100 and right / every > 0.8


def test_windows_and_reconciliation():
    text = "x" * 200 + "mail a.b@c.de now" + "y" * 100
    spans = pii.matches(text)[0]
    numbers, _ = pii.windows(text)
    tags = pii.tags_of(len(text), spans)[numbers[:, None] * pii.STRIDE + np.arange(pii.WINDOW)]
    assert pii.reconcile(numbers, tags, len(text)) == spans


def test_odd_rows(spark, odd, nothing):
    rows = odd.withColumn("base", F.lit(1)).select("*")
    got = pii.find(rows, None)
    assert got.count() == odd.count()
    assert all(not r.base for r in got.filter("doc_id in (2, 3, 4)").collect())
    masked = pii.mask(got)
    assert masked.filter("doc_id = 2").first().text is None
    assert pii.find(nothing, pii.train(nothing)).count() == 0


def test_mask(spark):
    df = spark.createDataFrame([(1, "é write to a.b@c.de or +1 555 123 4567!", 5)], "doc_id long, text string, extra int")
    out = pii.mask(pii.find(df, None))
    assert out.first().text == "é write to <email> or <phone>!" and out.columns == ["doc_id", "text", "extra"]


def test_tagger_adds_what_no_pattern_knows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    tagger = pii.train(docs.filter("doc_id % 2 = 0"))
    wanted = [
        (3, "(555) 123-4567"), (3, "555.123.4567"), (2, "4111.1111.1111.1111"), (1, "10. 20. 30. 40"),
        (0, "jean.99@mäil5.example.com"),
    ]
    texts = [f"on the other hand the man went there and {span} then all was well with them" for _, span in wanted]
    base, added = pii.all_spans(texts, tagger)
    assert not any(base)
    assert [[(k, t[a:b]) for k, a, b in spans] for t, spans in zip(texts, added)] == [[w] for w in wanted]
    # What fails its own kind's check stays out, and so do other numbers.
    others = ["4111 1111 1111 1112", "4111.1111.1111.1112", "300. 1. 1. 1", "2024-01-31 12:30:00"]
    assert pii.all_spans([f"on the other hand {span} was there" for span in others], tagger)[1] == [[]] * len(others)


class Fixed:
    """Tags every character as of one kind."""

    def __init__(self, kind):
        self.kind = kind

    def decode(self, classes):
        return np.full(classes.shape, 2 + 2 * self.kind, np.int8)


def test_failed_matches_of_other_kinds_do_not_suppress():
    for kind, text in [(3, "(555) 123-4567"), (3, "0049 170 1234567"), (2, "4111.1111.1111.1111"), (1, "10. 20. 30. 40")]:
        assert pii.all_spans([text], Fixed(kind)) == ([[]], [[(kind, 0, len(text))]])
    for text in ("4111 1111 1111 1112", "12 34"):
        assert pii.all_spans([text], Fixed(2)) == ([[]], [[]])


def test_find_and_mask_in_one_step(spark, odd, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    tagger = pii.train(docs)
    for df in (docs, odd.select("doc_id", "text").filter("doc_id not in (5, 6)"), docs.limit(0)):
        two = sorted((r.doc_id, r.text or "") for r in pii.mask(pii.find(df, tagger)).collect())
        assert two == sorted((r.doc_id, r.text or "") for r in pii.find_and_mask(df, tagger).collect())
    # Overlapping spans: the first one's kind stands for the stretch it begins.
    assert pii.masked_text("abcdef", [(1, 0, 3), (2, 1, 5)]) == f"a<{pii.KINDS[0]}>f"
