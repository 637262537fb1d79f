import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataflow.llm import pii
from strataflow.llm.queries import tokenizer_path


def test_stages(spark, sf, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "personal_data", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, outs = docs.columns, {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = outs[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
    # Clean documents stay; of each group one does.
    assert outs["language"].count() == outs["start"].filter(F.col("text").rlike(r"\p{L}")).count()
    texts = [r.text for r in outs["near_duplicates"].collect()]
    assert len(texts) == len(set(texts))
    assert outs["personal_data"].count() == len(texts)
    assert not any(pii.matches(r.text)[0] for r in outs["personal_data"].collect())
    words = outs["personal_data"].agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    mixed = outs["mixing"].agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(mixed / words - 1.5) < 0.05
    packed = outs["packing"].agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert packed[0] / packed[1] > 0.95 * 2048
    check_sequences(outs["mixing"], outs["packing"])


def check_sequences(mixed, packing):
    """The ids of all sequences are those of the mixed texts, as the tokenizer gives them one by one."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter((r.doc_id, tuple(tokenizer.encode(r.text, add_special_tokens=False).ids) + (1,)) for r in mixed.collect())
    pieces = defaultdict(list)
    for r in packing.collect():
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        pieces[r.sequence_id].append((r.offset, r.doc_id, r.start, ids))
    texts, got = defaultdict(Counter), defaultdict(Counter)
    for (doc, ids), n in want.items():
        for token in ids:
            texts[doc][token] += n
    for parts in pieces.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *[len(p[3]) for p in parts[:-1]]]).tolist()
        for _, doc, _, ids in parts:
            got[doc].update(ids)
    assert got == texts


def test_odd_documents(spark, odd, tmp_path):
    docs = odd.drop("fp").withColumn("n_chars", F.char_length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_one_row_per_component(spark, odd):
    """Rows that share an id, or have none, are told apart by their texts; copies are kept once."""
    other = [" ".join(f"{kind}{i}" for i in range(50)) for kind in ("one", "two", "three")]
    rows = [
        (None, other[0]), (None, other[1]), (None, other[1]), (21, other[2]), (None, other[2]),
        (22, other[2]), (21, "an unlike text"), (21, "an unlike text"),
    ]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("a"), "n_chars": F.char_length("text").cast("long")})
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert len(kept) == len(set(kept))
    assert sum(doc_id == 12 for doc_id, _ in kept) == 2
    assert {text for doc_id, text in kept if doc_id is None} >= {other[0], other[1]}
    assert [doc_id for doc_id, text in kept if text == other[2]] == [21] and (21, "an unlike text") in kept
    root = {simhash_of(text) for _, text in kept}
    assert len(root) == len(kept)


def simhash_of(text):
    from strataflow.llm import simhash

    return simhash.fingerprint(text)
