import pytest

LONG = "word " * 30_000 + "x" * 5_000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and extra columns named like results and helpers."""
    text = "\n".join(" ".join(f"w{(7 * i + 3 * j) % 50}" for j in range(12)) for i in range(8))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [
        (1, text), (2, text), (2, text), (3, other + " " + text), (4, other), (5, None), (6, ""), (7, " \t\n \x0b"), (None, text), (None, None),
        (8, "one"), (9, "one"), (10, "a b c d e"), (11, LONG), (12, "é ü 日本 " * 30), (13, other.replace("v30", "changed")),
        (14, "<|endoftext|> İΣ́ \x00  "), (15, text + "\n" + text),
    ]
    return spark.createDataFrame(
        [(d, t, k, 0, "s", 1.0) for k, (d, t) in enumerate(rows)],
        "doc_id long, text string, part long, n_words long, score string, kept_text double")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def more_documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
