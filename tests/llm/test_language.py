import numpy as np
import pandas as pd

from strataflow.llm import language


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.filter(~language.held_out()), per_language=64)
    rows = language.identify(docs.filter(language.held_out()), model).select("lang", "lang_pred", "score").collect()
    assert len(rows) > 100
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_lengths_by_hand():
    text = "abracadabra abracadabra"
    gram, n = np.unique(language.grams([text])[0], return_counts=True)
    tree = language.ContextTree(gram, n)
    raw = b"\0\0\0" + text.encode()

    def bits(context, byte):
        total = 0.0
        for order in range(3, -1, -1):
            c = context[3 - order :]
            follow = [raw[i + order] for i in range(3 - order, len(raw) - order) if raw[i : i + order] == c]
            if not follow:
                continue
            kinds = len(set(follow))
            if byte in follow:
                return total + np.log2((len(follow) + kinds) / follow.count(byte))
            total += np.log2((len(follow) + kinds) / kinds)
        return total + 8.0

    for context, byte in [(b"abr", ord("a")), (b"abr", ord("z")), (b"zzz", ord("a")), (b"zra", ord("c")), (b"xyz", 200)]:
        gram = np.array([int.from_bytes(context + bytes([byte]), "big")], dtype=np.uint32)
        assert abs(tree.bits(gram)[0] - bits(context, byte)) < 1e-9


def test_table_equals_trees():
    counts = []
    for lang, text in (("x", "the cat sat on the mat"), ("y", "der hund und die katze")):
        gram, n = np.unique(language.grams([text])[0], return_counts=True)
        counts.append(pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n}))
    model = language.Model.fit(pd.concat(counts))
    texts = ["the hund", "", "katze!", "zzzz 123"]
    want = [[t.bits(language.grams([x])[0]).sum() for t in model.trees] for x in texts]
    assert np.allclose(model.totals(texts), want, atol=1e-3)


def test_odd_rows(spark, odd, nothing):
    model = language.train(odd)
    got = language.identify(odd, model)
    assert got.columns == [*odd.columns, "lang_pred", "score"]
    by = {(r.doc_id, r.text): r for r in got.collect()}
    for key in [(2, None), (3, ""), (4, " \t\n "), (10, "12345 67890 ...")]:
        assert by[key].lang_pred == "und" and by[key].score == 0.0
    assert got.count() == odd.count()
    empty = language.train(nothing)
    assert language.identify(nothing, empty).count() == 0
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}


def test_only_unicode_letters_are_letters():
    assert not any(language.has_letter(t) for t in ("½", "²", "①", "Ⅷ", "٣", "_", "12 ¾", "", "\u0301"))
    assert all(language.has_letter(t) for t in ("a", "½ é", "中", "ª", "ʰ", "Ж"))
