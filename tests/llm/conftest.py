import pytest

EDGE = [None, "", " \n\t", "a", "A b c d", "one two three four five", "one two three four five", "x" * 30000, "wörd ñandú 東京 " * 40, "line\nline\n\nline\n", "a\r\nb\x0bc\x0c d\n"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash with the operators' own."""
    rows = [(i, t, "s" if i % 2 else None, 1, "x") for i, t in enumerate(EDGE)] + [(6, EDGE[6], None, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _id int, n_removed string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark):
    from support import DATA

    return spark.read.parquet(f"{DATA}/documents.parquet")
