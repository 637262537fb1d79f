import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataflow.llm import divergence
from strataflow.llm.queries import ORACLES, op11_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def want(rows, min_docs=3, most=200):
    """rows of text, lang, source -> the audit, group by group and term by term."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = terms_of(text)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        v = len(kept)
        groups = {s: c for (l, s), c in counts.items() if l == lang}
        total = Counter()
        for c in groups.values():
            total.update(c)

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + v)

        shares = {s: {t: p(c, t) for t in kept} for s, c in groups.items()}
        whole = {t: p(total, t) for t in kept}

        def ranked(values, source, part):
            for rank, (value, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= most:
                    out.add((lang, source, part, item, value, rank))

        for s in groups:
            ranked([(sum((shares[s][t] - shares[r][t]) ** 2 // shares[r][t] for t in kept), r) for r in groups if r != s], s, "pair")
            ranked([((shares[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if groups[s][t] and shares[s][t] > whole[t]], s, "term")
    return out


def check(rows, got):
    got = [tuple(r) for r in got]
    assert len(set(got)) == len(got)
    assert set(got) == want(rows)


def test_table_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source").collect()
    check(rows, op11_divergence(spark, sf).collect())


def test_odd_rows(spark, odd, nothing):
    check(odd.select("text", "lang", "source").collect(), divergence.audit(odd).collect())
    assert divergence.audit(nothing).count() == 0


def test_documents_are_counted_once_over_chunks(spark):
    """'the' and 'the,' of one document are one document; three rare chunks of three documents keep a term."""
    rows = [
        ("the the, The! the-the", "en", "a"), ("(the)", "en", "b"),  # two documents
        ("rare1 x", "en", "a"), ("rare2 x", "en", "b"), ("RARE3 x", "en", "c"),
        ("pair,pair pair;pair", "en", "a"), ("pair", "en", "a"), ("pair", "en", "c"),
        ("1234 ...", "en", "d"), (None, "fr", "d"), ("only only only only", "fr", "e"), (None, None, None),
        ("Éa éa ÉA ÄÄ𝔸", "de", "a"), ("éa", "de", "b"), ("Éa éA", "de", "b"),
    ]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = divergence.audit(docs).collect()
    check(rows, got)
    kept = {r.item for r in got if r.part == "term"}
    assert "rare" in kept and "pair" in kept and "the" not in kept and "only" not in kept


def test_many_sources_and_ranks(spark):
    letters = "abcdefghij"
    words = [f"{letters[i % 10]}{letters[i // 10 % 10]}{letters[i // 100]}," for i in range(900)]
    rows = [(" ".join(words[i % 97 :: 1 + i % 5]), "en", f"s{i % 23}") for i in range(120)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    check(rows, divergence.audit(docs).collect())


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(9 * 10**14, 10**15, 7)], "c long, n long, v long")
    got = df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (9 * 10**14 + 1) // (10**15 + 7)


def test_clashing_names_and_limits(spark, odd):
    named = odd.withColumnsRenamed({"fp": "chunk"}).withColumn("term", F.lit("x")).withColumn("n", F.lit(1)).withColumn("docs", F.lit(0))
    assert divergence.audit(named).count() == divergence.audit(odd).count()
    with pytest.raises(ValueError):
        divergence.vocabulary(odd, min_docs=4)
    assert "op11_divergence" in ORACLES


def test_small_flushes(spark, monkeypatch):
    """Tasks that hand on what they hold all the time, and pairs cut into slices, give the same sums."""
    rows = [(f"a{'xyz'[i % 3]} b,c b {'lmnop'[i % 5]} {'qrs'[i % 3]}-a", "en" if i % 4 else "de", f"s{i % 7}") for i in range(50)]
    part = pa.table({"lang": ["en"] * 4, "chunk": ["a", "a-b", "b", "b"], "docs": [3, 1, 1, 2], "low": [0, 5, 6, 7], "high": [0, 5, 6, 8], "nos": [[0], [0, 1], [1], [2]], "ns": [[9], [1, 2], [1], [4]]})
    df = spark.createDataFrame(part)
    got = {(r.lang, r.term): dict(zip(r.nos, r.ns)) for r in divergence.merged_terms(divergence.with_terms(df), 3).collect()}
    assert got == {("en", "a"): {0: 10, 1: 2}, ("en", "b"): {0: 1, 1: 3, 2: 4}}
    monkeypatch.setattr(divergence, "MOST_BYTES", 50)
    monkeypatch.setattr(divergence, "MOST_HELD", 3)
    monkeypatch.setattr(divergence, "MOST_ROWS", 2)
    monkeypatch.setattr(divergence, "MOST_PAIRS", 4)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    check(rows, divergence.audit(docs).collect())


def test_shares_of_longs():
    counts, whole = [0, 5, 9 * 10**14], [3, 17, 9 * 10**15]
    got = divergence.shares(np.array(counts, dtype=np.int64), np.array(whole, dtype=np.int64))
    assert got.tolist() == [1 + 10**9 * (c + 1) // w for c, w in zip(counts, whole)]


def test_runs_of_texts():
    texts = ["", "a b", "c", "\x0b d\x1ce\u00a0f \n", " ", "\u00e4\u00f6 \u00e4", "", "g"]
    for array in (pa.array(texts), pa.array(["zz zz", *texts])[1:], pa.array(texts)[:0], pa.array([" "])):
        chunks, doc = divergence.runs_of(array, divergence.CHUNK_BYTES)
        want = [(c.decode(), i) for i, t in enumerate(array.to_pylist()) for c in t.encode().split()]
        assert list(zip(chunks.to_pylist(), doc.tolist())) == want
    terms, at = divergence.runs_of(pa.array(["a1b", "12", "é_x\U0001d538"]), divergence.TERM_BYTES)
    assert list(zip(terms.to_pylist(), at.tolist())) == [("a", 0), ("b", 0), ("é", 2), ("x\U0001d538", 2)]
