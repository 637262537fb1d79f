import pytest

from strataflow.llm.common import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity: nulls, empty, long, repeated rows, copies, and columns with clashing names."""
    long_text = " ".join(f"word{i % 700} {i}" for i in range(9_000))
    shared = " ".join(f"common{i}" for i in range(60))
    rows = [
        (1, "Hello there, world. This is a line.\nAnother line follows here.", "en", "a", "x"),
        (1, "Hello there, world. This is a line.\nAnother line follows here.", "en", "a", "x"),
        (2, None, None, None, None),
        (3, "", "en", "a", "x"),
        (4, " \t\n ", "fr", "b", "x"),
        (5, long_text, "en", "b", "x"),
        (6, long_text, "en", "b", "x"),
        (7, "begin seven " + shared + " end seven", "de", "c", "x"),
        (8, "start eight " + shared + " stop eight", "de", "c", "x"),
        (9, "tail " + shared, None, "c", None),
        (None, "no id " + shared, "de", None, "x"),
        (10, "12345 67890 ...", "de", "a", "x"),
        (11, "ÄÖÜ ßé emoji 😀 text 😀 ends", "de", "a", "x"),
        (12, "a" * 4_000, "en", "a", "x"),
        (12, "different text with the same id", "en", "a", "x"),
    ]
    names = "doc_id long, text string, lang string, source string, fp string"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
