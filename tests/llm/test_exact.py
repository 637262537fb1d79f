import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from strataflow.llm import exact
from strataflow.llm.queries import op13_exact


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def want(rows):
    """(doc_id, sha) -> keep_id, group_size; and the number of rows that stay per text."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[lowered(text)].append(i)
    out = {}
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            out[i, hashlib.sha256(text.encode()).hexdigest()] = (max(known) if known else None, len(ids))
    return out, len(groups)


def check(rows, got):
    expected, texts = want(rows)
    assert len(got) == len(rows)
    for r in got:
        assert expected[r.doc_id, r.text_sha256] == (r.keep_id, r.group_size)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == texts
    assert len({r.text_sha256 for r in got if r.kept}) == texts


def test_table_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, op13_exact(spark, sf).collect())


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(rows, exact.mark(odd).collect())
    assert exact.mark(nothing).count() == 0
    assert exact.deduplicate(nothing).count() == 0


def test_case_and_ids(spark):
    rows = [(1, "ABC é"), (2, "abc é"), (3, "abc É"), (None, "x"), (None, "X"), (4, None), (5, ""), (6, "y"), (6, "Y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(rows, exact.mark(docs).collect())


def test_hot_group_and_full_filter(spark):
    """A third of all rows are one text; with a quarter of a bit per row the filter lets all rows be shuffled."""
    rows = [(i, "hot" if i % 3 == 0 else f"text {i // 2 if i % 7 == 0 else i}") for i in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(rows, exact.mark(docs).collect())
    check(rows, exact.mark(docs, bits_per_row=1).collect())


def test_filter_passes_single_rows_and_no_repeat(spark):
    digests = spark.range(40_000).select(F.unhex(F.sha2((F.col("id") - F.when(F.col("id") % 100 == 1, 1).otherwise(0)).cast("string"), 256)).alias("d"), "id")
    blocks = exact.blocks_for(40_000, 16)
    assert blocks == 3
    found = exact.repeat_filter(digests, "d", blocks)
    rows = {r.id for r in exact.probed(digests, "d", found, blocks).filter("suspect").collect()}
    repeated = {i for k in range(0, 40_000, 100) for i in (k, k + 1)}
    assert repeated <= rows
    assert len(rows - repeated) < 0.03 * 40_000


def test_codes():
    for n in (0, 1, exact.BLOCK // 32 - 1, exact.BLOCK // 32, exact.BLOCK):
        at = np.sort(np.random.default_rng(n).choice(exact.BLOCK, n, replace=False))
        assert (exact.decoded(exact.coded(at)) == at).all()


def test_deduplicate_keeps_columns(spark, odd):
    rows = exact.deduplicate(odd)
    assert rows.columns == odd.columns
    texts = {lowered(r.text) for r in odd.collect()}
    kept = rows.collect()
    assert {lowered(r.text) for r in kept} == texts and len(kept) == len(texts)
    assert {r.doc_id for r in kept if lowered(r.text).startswith("word0")} == {6}
    named = odd.withColumnsRenamed({"fp": "digest", "lang": "suspect", "source": "block"})
    assert exact.deduplicate(named).columns == named.columns and exact.deduplicate(named).count() == len(texts)


def test_plan_shuffles_suspects_only(spark, sf):
    plan = exact.mark(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastHashJoin" in plan
