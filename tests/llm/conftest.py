import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
SHARED = " ".join(f"s{i}" for i in range(20))
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "same " * 40), (7, "same " * 40), (8, "a b c d e"), (9, f"x {SHARED} y"),
    (10, f"{SHARED} z {SHARED}"), (11, "x" * 9000), (12, LONG), (13, LONG + " end"), (14, "é \U0001f600 中文 <|endoftext|> a  b\n\n c"), (15, "The MIT License, under the apache-license; GENERAL public license mit license"), (16, "a\x1fb   c\x85d"),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, and extra columns that are named as the operators' own."""
    extra = "lang string, source string, n_chars long, bucket string, owner string, size string, score string, n_words string, component_id string, `n.key` string"
    return spark.createDataFrame([(i, t, None, None if i % 5 == 0 else f"s'{i % 3}", None, *["?"] * 7) for i, t in ODD], "doc_id long, text string, " + extra)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
