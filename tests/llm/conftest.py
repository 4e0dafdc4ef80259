import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, ties, repeated rows, a very long text, and columns with names that operators use inside."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    same = " ".join(f"tok{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, same), (6, same), (6, same), (7, long), (None, "a null id of some words"), (8, "é ü 日本 don't 'll"), (9, "a" * 5000), (10, same + " more words here")]
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, lang string, h int, row_id int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
