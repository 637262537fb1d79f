import zlib
from collections import defaultdict

import numpy as np
import pytest

from strataflow.llm import packing
from strataflow.llm.queries import tokenizer_path


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], dtype="<u4") for x in texts]


def check(rows, texts, capacity):
    """``texts``: (doc_id, text) pairs; every id lies in one piece, offsets have no gaps."""
    want = defaultdict(list)
    for (doc, _), ids in zip(texts, plain_ids([t for _, t in texts])):
        want[doc].append(ids)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for doc, ids in want.items():
        assert sum(r.length for r in pieces[doc]) == sum(map(len, ids))
        if len(ids) == 1:
            at = 0
            for r in sorted(pieces[doc], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids[0])
                assert r.ids_crc32 == zlib.crc32(ids[0][at : at + r.length].tobytes())
                at += r.length
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(r.length for r in rows) / (capacity * len(sequences))


@pytest.mark.parametrize("window", [3_000, 1 << 21])
def test_every_id_once(spark, sf, window):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, tokenizer_path(), window_tokens=window).collect()
    fill = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert fill > 0.97


def test_odd_rows(spark, odd, nothing):
    rows = packing.pack(odd, tokenizer_path(), sequence_tokens=64, with_ids=True).collect()
    check(rows, [(r.doc_id, r.text) for r in odd.collect()], 64)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    assert packing.pack(nothing, tokenizer_path()).count() == 0


def test_descending_to_cheapest_with_room():
    lengths = np.array([60, 50, 40, 30, 20])
    pieces, left = packing.place(lengths, 2, 100, 1.0, 0.01)
    assert not left.any()
    # 60 and 50 open both; 40 goes to the cheaper one (50), 30 to the other, then 20 is cut over what is left.
    assert pieces[:4] == [(0, 0, 60, 0), (1, 0, 50, 1), (2, 0, 40, 1), (3, 0, 30, 0)]
    assert sorted((s, n) for item, s, n, _ in pieces if item == 4) == [(0, 10), (10, 10)]
    pieces, left = packing.place(lengths, 1, 100, 1.0, 0.01)
    assert sum(n for _, _, n, _ in pieces) == 100 and left.sum() == 100


def test_words_are_encoded_once_whatever_marks_follow():
    words = [f"{a}{b}" for a in ("ger", "lyn", "tion", "é", "ß") for b in ("an", "ou", "era")]
    texts = [f"{w}{mark} ({w}) {w}{number}" for w in words for mark in (".", ",", "!!", "$$$") for number in (7, 12, 345)]
    ids = packing.WordIds(tokenizer_path())
    assert list(ids.encode(texts)) == [x.tobytes() for x in plain_ids(texts)]
    assert len(ids.known) < 60  # not each word with each mark and number, which are 121


def test_ids_are_those_of_whole_texts():
    import random

    parts = ["a", "b", "Z", "s", "t", "ll", "re", "'", "'s", "'S", "''", "<|", "|>", "<|endoftext|>", ".", "$", "-", "1", "23", "é", "İ", "K", "…", "́",
             "̸", "<", "=", "\0", "\x1c", "\x7f", "\x85", "\xa0", " ", "  ", "\t", "\r\n", "漢", "ᄀ", "ᅡ", "😀", "٣", "²", "ª", "﻿", ";", "`", "ﬁ"]
    rng = random.Random(5)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 24))) for _ in range(5_000)] + [None, "", " ", "\n\n"]
    ids = packing.WordIds(tokenizer_path(), keep=500)
    got = [x for lo in range(0, len(texts), 300) for x in ids.encode(texts[lo : lo + 300])]
    assert got == [x.tobytes() for x in plain_ids(texts)]


def test_few_bytes_of_ids_wait_in_a_task():
    packer = packing.Packer(0, 2048, 1 << 21, 1.0, 1.0, True)
    ids = bytes(4 * 2048 * 700)
    packer.add(1, ids)
    assert packer.full() and sum(map(len, packer.frame(["a", "b", "c", "d", "e", "f", "g"])["ids"])) == len(ids)
    assert not packer.full()
