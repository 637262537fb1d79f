"""Vector and keyword search against plain loops."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.operators import search


def nearest(docs, queries, k):
    """(query, doc, rank) of the k largest cosines, ties by id."""
    out = set()
    for q, a in queries:
        def cosine(b):
            size = np.linalg.norm(a) * np.linalg.norm(b)
            return float(np.dot(a, b) / size) if size else 0.0

        best = sorted(((-round(cosine(v), 12), d) for d, v in docs if d is not None and v is not None))[:k]
        out |= {(q, d, rank) for rank, (_, d) in enumerate(best, 1)}
    return out


def frame(spark, rows, kind="long"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"id {kind}, embedding array<float>").repartition(4)


def found(spark, docs, queries, k, kind="long", **sizes):
    out = search.semantic_search(frame(spark, docs, kind), frame(spark, queries).withColumnRenamed("id", "query_id"), k, doc_id="id", **sizes)
    return {(r.query_id, r.id, r.rank_no) for r in out.collect()}


@pytest.mark.parametrize("sizes", [{}, {"group_vectors": 17, "group_queries": 3}, {"group_vectors": 1, "group_queries": 1}])
def test_top_k_for_any_group_size(spark, sizes):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, size=(120, 4))  # many equal directions: ties
    docs = [*enumerate(vectors), (None, [1, 1, 1, 1]), (500, None), (501, [0, 0, 0, 0])]
    queries = [(q, vectors[q]) for q in range(0, 120, 10)]
    assert found(spark, docs, queries, 7, **sizes) == nearest(docs, queries, 7)


def test_fewer_documents_than_k_string_ids_and_no_rows(spark):
    docs = [(f"d{i}é", [i, 1]) for i in range(4)]
    queries = [(1, [1, 0]), (2, [0, 1])]
    assert found(spark, docs, queries, 9, "string") == nearest(docs, queries, 9)
    empty = frame(spark, [(1, [1.0])]).limit(0)
    asked = frame(spark, queries).withColumnRenamed("id", "query_id")
    assert search.semantic_search(empty, asked, 3, doc_id="id").count() == 0
    assert search.semantic_search(frame(spark, docs, "string"), asked.limit(0), 3, doc_id="id").count() == 0


def test_hot_vector_is_streamed(spark):
    """A third of all documents are one vector: they share a slice and the smallest ids win."""
    docs = [(i, [1, 0] if i % 3 == 0 else [1, i]) for i in range(3_000)]
    queries = [(0, [1, 0]), (1, [1, 1])]
    assert found(spark, docs, queries, 5, group_vectors=100) == nearest(docs, queries, 5)


def test_counts_are_part_of_the_plan(spark):
    docs = spark.range(50_000).select(F.col("id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    asked = docs.limit(3).withColumnRenamed("id", "query_id")
    plan = search.semantic_search(docs, asked, 5, doc_id="id")._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


TEXTS = ["Stuck pipe in WELL", "lost circulation, losses", None, "", "pipe pipe stuck", "Ünstuck ÄÖ well", "no", "stu ck pip e", "stuck pipe in well\nsecond line", "100% sure_thing"]


def plain_search(rows, queries, n):
    out = set()
    for q, text in queries:
        words = search.keywords(text or "")
        hits = []
        for i, (source, date, no, doc) in enumerate(rows):
            found = sum(w in (doc or "").lower() for w in words)
            if found or not words:
                hits.append((source, date is None, date or "", no, found))
        best = []
        for source in {h[0] for h in hits}:
            best += sorted(h for h in hits if h[0] == source)[:n]
        out |= {(q, rank, h[0], h[3], h[4]) for rank, h in enumerate(sorted(best)[:n], 1)}
    return out


def keyword_rows(spark):
    rows = [(1 + i % 2, None if i % 7 == 0 else f"2013-01-{1 + i % 5:02d}", i, TEXTS[i % len(TEXTS)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "source_no int, date string, doc_no long, text string").withColumn("well", F.lit("15_9_F_1")).repartition(3)
    return rows, docs


def test_table_of_queries_against_loops_and_literals(spark):
    rows, docs = keyword_rows(spark)
    queries = [(1, "stuck PIPE"), (2, "of to"), (3, "nothing matches this"), (4, "well well lost"), (5, None), (6, "äö 100% sure_thing"), (7, "line\tsecond"), (8, "")]
    asked = spark.createDataFrame(queries, "query_id long, query string")
    for n in (1, 4, 100):
        got = search.keyword_search_table(docs, asked, n).collect()
        assert {(r.query_id, r.rank_no, r.source_no, r.doc_no, r.n_hits) for r in got} == plain_search(rows, queries, n)
        literal = search.keyword_search(docs, [q or "" for _, q in queries], n).collect()
        assert {(r.query_id, r.rank_no, r.doc_no, r.n_hits, r.text) for r in got} == {(r.query_no + 1, r.rank_no, r.doc_no, r.n_hits, r.text) for r in literal}


def test_table_of_queries_keeps_equal_rows(spark):
    docs = spark.createDataFrame([(1, None, 7, "stuck pipe", "w")] * 5 + [(1, None, 8, "pipe", "w")], "source_no int, date string, doc_no long, text string, well string")
    asked = spark.createDataFrame([(1, "stuck pipe"), (2, "pipe pipe")], "query_id long, query string")
    got = sorted((r.query_id, r.rank_no, r.doc_no, r.n_hits) for r in search.keyword_search_table(docs, asked, 6).collect())
    assert got == [(1, k, 7, 2) for k in range(1, 6)] + [(1, 6, 8, 1)] + [(2, k, 7, 2) for k in range(1, 6)] + [(2, 6, 8, 2)]
    assert len(search.keyword_search_table(docs, asked, 2).collect()) == 4
    assert search.keyword_search_table(docs.limit(0), asked, 2).count() == 0
    assert search.keyword_search_table(docs, asked.limit(0), 2).count() == 0


def test_plan_does_not_grow_with_the_queries(spark):
    _, docs = keyword_rows(spark)

    def plan(n):
        asked = spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("query"))
        return search.keyword_search_table(docs, asked, 5)._jdf.queryExecution().optimizedPlan().toString()

    assert abs(len(plan(1_000)) - len(plan(3))) < 100
    assert "Cartesian" not in plan(3)


def test_words_are_looked_for_in_distinct_tokens(spark):
    tokens = ["thing", "things", "something", "in", "a𝒳b𝒳cd", "𝒳b𝒳", "aaaaaaaa", "customer_0001", "customer_00012", "x" * 500 + "customer_0001", "ölüng", "ab\u200bcd"]
    words = ["thing", "hin", "𝒳b𝒳", "b𝒳cd", "aaa", "aaaaaaa", "customer_0001", "00012", "ölü", "lün", "none", "thingsome", "b\u200bc", "mething"]
    got = search.tokens_with(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w,) for w in tokens], "token string")).collect()
    assert sorted((r.word, r.token) for r in got) == sorted((w, t) for w in words for t in tokens if w in t)


def test_texts_are_cut_at_all_white_space_and_never_searched_for_lists(spark):
    blanks = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"
    rows = [(1, None, i, f"un{b}stuck{b}{b}pipes") for i, b in enumerate(blanks)] + [(1, None, 100, "stuck\u200bpipe")]
    docs = spark.createDataFrame(rows, "source_no int, date string, doc_no long, text string").withColumn("well", F.lit("w"))
    queries = [(i, f"STUCK{b}pipe") for i, b in enumerate(blanks)] + [(100, "k\u200bp"), (101, "unstuck")]
    out = search.keyword_search_table(docs, spark.createDataFrame(queries, "query_id long, query string"), 30)
    assert {(r.query_id, r.rank_no, r.source_no, r.doc_no, r.n_hits) for r in out.collect()} == plain_search(rows, queries, 30)
    searched = set(re.findall(r"Contains\((\w+)#", out._jdf.queryExecution().optimizedPlan().toString()))
    # Texts are searched only for the words of the queries that list them.
    assert searched == {"token", "_lowered"}, searched


def test_a_common_word_costs_its_first_texts_only(spark):
    docs = spark.range(3_000).select(F.lit(1).alias("source_no"), F.lit(None).cast("string").alias("date"), F.col("id").alias("doc_no"), F.lit("w").alias("well"), F.concat(F.lit("common common"), F.col("id") % 3, F.lit(" rest")).alias("text"))
    asked = spark.createDataFrame([(1, "common"), (2, "mmo rest"), (3, "common2")], "query_id long, query string")
    out = search.keyword_search_table(docs, asked, 4).collect()
    assert sorted((r.query_id, r.doc_no, r.n_hits) for r in out) == [(1, i, 1) for i in range(4)] + [(2, i, 2) for i in range(4)] + [(3, i, 1) for i in (2, 5, 8, 11)]
