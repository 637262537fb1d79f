import numpy as np

from strataflow.llm import multi_index


def brute(rows, every, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        own = x[np.flatnonzero(ids == q)[0]]
        d = np.sqrt(((x - own) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_recall_on_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], 100, 10)
    got = {}
    for r in multi_index.search(vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_exact_with_all_cells_ties_and_copies(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 6)), np.ones((40, 6))])
    rows = [(i, x[i].tolist()) for i in range(100)]
    odd = [(200, None), (201, [0.0] * 6), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (None, [1.0] * 6), (205, [1.0])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows + odd], "vec_id long, embedding array<float>, score string")
    want = brute([(i, np.array(v, dtype=np.float32)) for i, v in rows], 10, 7)
    got = {}
    for r in multi_index.search(df, k=7, every=10, share=1.0, centroids=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(np.isclose(a[1], b[1], rtol=1e-14) for q in got for a, b in zip(got[q], want[q]))


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r["rank"]) for r in multi_index.search(df).orderBy("rank").collect()] == [(3, 1), (1, 2)]
    assert multi_index.search(df.limit(0)).count() == 0
    assert multi_index.search(df.filter("vec_id = 0")).count() == 0


def test_walk_is_in_order_of_distance():
    rng = np.random.default_rng(0)
    books = rng.normal(size=(5, 3)), rng.normal(size=(4, 3))
    q = rng.normal(size=6)
    counts = np.ones(20, dtype=int)
    total = (multi_index.squared(q[None, :3], books[0])[0][:, None] + multi_index.squared(q[None, 3:], books[1])[0][None]).ravel()
    assert multi_index.walk(q, books, counts, 20) == list(np.argsort(total, kind="stable"))
    assert len(multi_index.walk(q, books, counts, 7)) == 7


def test_clustered_vectors_need_few_entries(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(40, 16)) * 10
    x = centre[rng.integers(40, size=6000)] + rng.normal(size=(6000, 16)) * 0.3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    looked = []
    real = multi_index.entries_needed
    monkeypatch.setattr(multi_index, "entries_needed", lambda *a: looked.append(real(*a)) or looked[-1])
    got = {}
    for r in multi_index.search(df, every=20, part_rows=300, query_block=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, 20, 10)
    hits = sum(len({i for i, _ in want[q]} & got[q]) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(len(v) == 10 for v in got.values()) and 0 < looked[0] < 1200


def test_a_query_whose_id_repeats_still_gets_k(spark):
    rows = [(0, [1.0, 0.0])] * 30 + [(0, [5.0, 5.0])] + [(i, [1.0, i / 100]) for i in range(1, 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.search(df, every=100).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 11))


def test_more_centroids_for_larger_tables():
    sizes = [multi_index.centroids_for(n) for n in (0, 5_000, 51_282, 1_000_000, 10**10)]
    assert sizes == [16, 16, 32, 142, 256]
