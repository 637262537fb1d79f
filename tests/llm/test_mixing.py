import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.llm import mixing


def test_targets():
    got = mixing.targets([100, 10, 50], [3, 1, 2], 1.5, 2.0)
    assert np.allclose(got, [144, 20, 76]) or abs(got.sum() - 240) < 1e-9
    assert (got <= 2 * np.array([100, 10, 50]) + 1e-9).all()
    assert np.allclose(mixing.targets([0, 0], [1, 1], 1.5, 2.0), 0)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(n):
    size = np.full(n, n)
    for key in (1, 99):
        got = mixing.permuted(np.arange(n), size, np.full(n, key, dtype=np.uint64))
        assert sorted(got) == list(range(n))


def sized(docs):
    return docs.select("doc_id", "source", mixing.word_count().alias("size"))


def test_sources_meet_targets_and_runs_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base = sized(docs)
    a = mixing.taken_words(*mixing.mix(base)).select("doc_id", "size", "source", "target", "taken").collect()
    b = mixing.taken_words(*mixing.mix(base.repartition(7))).select("doc_id", "size", "source", "target", "taken").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert all(r.taken <= 2 * r["size"] for r in a)
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert all(r["size"] == words[r.doc_id] for r in a)
    for source in {r.source for r in a}:
        own = [r for r in a if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= mixing.BLOCK_WORDS


def test_documents_hold_what_was_taken(spark, odd):
    docs = odd.withColumn("n_chars", F.char_length("text").cast("long"))
    mixed = mixing.mixed_documents(docs, block=4)
    assert mixed.columns == docs.columns
    rows, taken = mixing.mix(sized(docs), block=4)
    want = {r.source: r.n for r in mixing.taken_words(rows, taken).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.word_count()).alias("n")).collect()}
    assert {s: n for s, n in want.items() if n} == got
    assert all(r.n_chars == len(r.text) for r in mixed.collect())


def test_clashing_names_of_documents(spark, odd):
    plain = odd.drop("fp")
    named = plain.withColumns({c: F.lit(i) for i, c in enumerate(["size", "target", "start", "source_no", "row", "row_no", "mixed", "runs", "pass_no"])})
    mixed = mixing.mixed_documents(named, block=4)
    assert mixed.columns == named.columns
    rows = mixed.collect()
    assert {(r["size"], r.target, r.start, r.source_no, r.row, r.row_no, r.mixed, r.runs, r.pass_no) for r in rows} == {tuple(range(9))}
    assert sorted((r.doc_id or 0, r.text) for r in rows) == sorted((r.doc_id or 0, r.text) for r in mixing.mixed_documents(plain, block=4).collect())


def test_odd_rows(spark, odd, nothing):
    got = mixing.taken_words(*mixing.mix(sized(odd), block=4)).collect()
    assert len(got) == odd.count()
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.taken_words(*mixing.mix(sized(nothing))).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0


def test_taken_text():
    runs = [{"from_word": 0, "n_words": 1}, {"from_word": 1, "n_words": 1}, {"from_word": 3, "n_words": 1}]
    assert mixing.taken_text("a\n b c\td", runs) == "a\n b d"


def test_draws_are_not_broadcast(spark):
    """A few draws become very many rows, whatever the planner takes them for."""
    docs = sized(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    _, taken = mixing.mix(docs)
    plan = taken._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [source_no" in plan.split("\n")[1] + plan.split("\n")[0] and len(taken.take(1)) == 1
