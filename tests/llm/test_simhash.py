import random

import numpy as np
import pytest

from strataflow.llm import simhash
from strataflow.llm.common import local_components
from strataflow.llm.components import connected_components


def brute(ids, prints, max_bits=4):
    u, inverse = np.unique(np.array(prints, dtype=np.uint64), return_inverse=True)
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= max_bits)
    label = local_components(len(u), a, b)[inverse]
    first = {}
    for part, i in zip(label, ids):
        if i is not None:
            first[part] = min(first.get(part, i), i)
    return [first.get(part) for part in label]


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    assert all(r.fp % (1 << 64) == plain_fingerprint(texts[r.doc_id]) for r in rows)
    assert [r.component_id for r in rows] == brute([r.doc_id for r in rows], [r.fp % (1 << 64) for r in rows])


@pytest.mark.parametrize("unit_rows", [7, 1000])
def test_dense_groups(spark, unit_rows):
    rng = random.Random(3)
    prints = []
    for _ in range(20):
        centre = rng.getrandbits(64)
        prints += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(rng.choice([1, 3, 60]))]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    links = simhash.near_links(df, unit_rows=unit_rows)
    roots = {r.node % (1 << 64): r.root for r in connected_components(links).collect()}
    got = [roots.get(p, simhash.signed(p)) for p in prints]
    want = brute(list(range(len(prints))), prints)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))
    assert links.count() < 20 * 70 * len(prints)


def test_block_keys_never_miss():
    rng = random.Random(5)
    for n in (5, 6, 7, 8):
        masks = simhash.block_masks(n)
        assert sum(masks) == (1 << 64) - 1
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << x for x in rng.sample(range(64), 4))
            assert sum((a & m) == (b & m) for m in masks) >= n - 4


def test_chain_of_components(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (2000, 1999)], "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1999: 1999, 2000: 1999}
    assert connected_components(df.limit(0)).count() == 0


def test_odd_rows(spark, odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2}
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert {r.fp for r in rows if r.doc_id == 3} == {0}
    assert simhash.near_duplicates(nothing).count() == 0


def test_units_are_judged_one_by_one_whatever_the_batches():
    import pandas as pd

    rng = np.random.default_rng(2)
    unit = np.sort(np.concatenate([rng.integers(0, 40, 300), np.full(200, 7), np.full(90, 39)])).astype(np.int64)
    fp = rng.integers(0, 1 << 10, len(unit)).astype(np.int64)
    for size in (1, 13, 150, 1000):
        batches = (pd.DataFrame({"unit": unit[lo : lo + size], "fp": fp[lo : lo + size]}) for lo in range(0, len(unit), size))
        links = pd.concat(simhash.linked_in_units(2)(batches))
        for u in np.unique(unit):
            mine = np.unique(fp[unit == u])
            a, b = np.nonzero(np.bitwise_count(mine[:, None] ^ mine[None, :]) <= 2)
            found = links[links["a"].isin(mine) & links["b"].isin(mine)]
            label = local_components(len(mine), a, b)
            have = local_components(len(mine), np.searchsorted(mine, found["a"]), np.searchsorted(mine, found["b"]))
            # Links of other units may only join what this unit's own pairs do not contradict.
            assert all(len(set(have[label == x])) == 1 for x in set(label))
        assert (np.bitwise_count(links["a"].to_numpy() ^ links["b"].to_numpy()) <= 10).all()
    assert list(simhash.linked_in_units(2)(iter([pd.DataFrame({"unit": unit[:0], "fp": fp[:0]})]))) == []
