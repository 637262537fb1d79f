import math

from strataflow.llm import licenses


def rows(spark):
    filler = " ".join(["thon andre erst"] * 40)
    return spark.createDataFrame(
        [
            (1, "a/LICENSE", "Released under the MIT License."),
            (2, "a/b/c/x.py", filler),
            (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
            (4, "a/b/c/y.py", "Licensed under CC BY-NC 4.0.\n" + filler),
            (5, "z/w.py", filler),
            (6, "a/w.py", None),
            (7, None, filler),
            (8, "w.py", ""),
            (1, "a/LICENSE", "Released under the MIT License."),
            (9, "ab/w.py", "we license nothing here and talk of other things at length instead of that"),
        ],
        "doc_id long, path string, text string",
    )


def test_nearest_ancestor(spark):
    got = {r.doc_id: (r.license, r.license_from, r.license_dir) for r in licenses.scan(rows(spark)).collect()}
    assert got == {
        1: ("MIT", "file", "a"),
        2: ("Apache-2.0", "inherited", "a/b"),
        3: ("Apache-2.0", "file", "a/b"),
        4: ("CC-BY-NC-4.0", "header", "a/b/c"),
        5: (None, "none", None),
        6: ("MIT", "inherited", "a"),
        7: (None, "none", None),
        8: (None, "none", None),
        9: (None, "none", None),
    }


def test_all_planted_lines(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("path", F.col("source"))
    planted = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "GNU General Public License, version 3.": "GPL-3.0", "Released under the MIT License.": "MIT", "Apache License, Version 2.0.": "Apache-2.0"}
    for r in licenses.scan(docs).collect():
        want = {v for k, v in planted.items() if k in (r.text or "")}
        assert (r.license_from in ("header", "file")) == bool(want)
        assert not want or r.license in want


def test_cosine_by_hand():
    scorer = licenses.Scorer({"mit": 2, "license": 3}, 10, [("MIT", "mit license")])
    w = {"mit": math.log(11 / 2) + 1, "license": math.log(11 / 3) + 1}
    other = math.log(11) + 1
    top = w["mit"] ** 2 / (math.hypot(*w.values()) * math.hypot(w["mit"], other))
    assert abs(scorer.best("MIT thing")[1] - top) < 1e-12


def test_empty(spark, odd, nothing):
    from pyspark.sql import functions as F

    assert licenses.scan(nothing.withColumn("path", F.lit("a/b"))).count() == 0
    got = licenses.scan(odd.withColumns({"path": F.lit("a/b"), "license": F.lit(1)}))
    assert got.count() == odd.count()


def wrapped(name, mark=""):
    """The longest text of a licence in lines of 70 characters."""
    import textwrap

    text = max((t for n, t in licenses.TEMPLATES if n == name), key=len)
    return "\n".join(mark + line for line in textwrap.wrap(text, 70))


def test_wrapped_texts(spark):
    filler = "\n\nthon andre erst = 1" * 40
    found = licenses.scan(
        spark.createDataFrame(
            [
                (1, "a/LICENSE", "MIT License\n\nCopyright (c) 2020 Jo Doe\n\n" + wrapped("MIT")),
                (2, "a/x.py", "thon andre erst"),
                (3, "b/17", "Copyright (c) 2020, Jo Doe\nAll rights reserved.\n\n" + wrapped("BSD-3-Clause")),
                (4, "b/x.py", "thon andre erst"),
                (5, "c/x.py", wrapped("Apache-2.0", "# ") + filler),
                (6, "c/y.c", "/*\n" + wrapped("GPL-3.0", " * ") + "\n */" + filler),
                (7, "c/z.py", "thon andre erst"),
                (8, "d/COPYING", "Preamble of a long text\n" + filler + "\n\n" + wrapped("GPL-3.0")),
                (9, "d/x.py", "thon andre erst"),
            ],
            "doc_id long, path string, text string",
        )
    )
    assert {r.doc_id: (r.license, r.license_from) for r in found.collect()} == {
        1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("BSD-3-Clause", "file"), 4: ("BSD-3-Clause", "inherited"),
        5: ("Apache-2.0", "header"), 6: ("GPL-3.0", "header"), 7: (None, "none"), 8: ("GPL-3.0", "file"), 9: ("GPL-3.0", "inherited"),
    }


def test_texts_may_be_left_out(spark):
    whole = licenses.scan(rows(spark))
    lean = licenses.scan(rows(spark), with_text=False)
    assert lean.columns == [c for c in whole.columns if c != "text"]
    assert sorted(map(str, lean.collect())) == sorted(map(str, whole.drop("text").collect()))
