import pytest

COPY = "the quick brown fox jumps over the lazy dog and then runs back home again before noon"
DOCS = [
    (1, COPY, "en", "b", 85),
    (2, COPY, "en", "b", 85),
    (3, COPY + " today", "en", "a", 91),
    (3, COPY + " today", "en", "a", 91),
    (4, None, None, None, None),
    (5, "", "en", "a", 0),
    (6, "one two three", "en", None, 13),
    (7, "ONE two THREE", "en", "c", 13),
    (8, " \n\t ", "en", "c", 4),
    (9, "line one here\nline one here\nline two\n\nline one here", "en", "d", 50),
    (None, "no id at all but some words in a row", "en", "a", 36),
    (10, " ".join(f"w{i % 977}x{i}" for i in range(30_000)), "en", "a", 1),
    (11, "x" * 50_000, "en", "e", 50_000),
    (12, "mail bob.b@ex-1.example.com, ip 10.0.0.255 and 1.2.3.256, card 4111 1111-1111 1111, call +1 (523) 555-1055.", "en", "a", 1),
    (13, "ünï cödé 😀 a@b.c d\n+44-20 7946.0958 zz 😀 9.9.9.9.9.9.9.9 4111111111111112", "de", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use."""
    return spark.createDataFrame(DOCS, SCHEMA).selectExpr("*", "'x' AS size", "1 AS shard", "2 AS id", "'k' AS key", "0 AS label", "false AS kept").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
