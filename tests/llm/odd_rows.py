import pytest
from helpers import SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, cls string, h string, times int, bucket int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, names that operators use themselves."""
    long = " ".join(f"w{i % 977} x{i % 13}" for i in range(40_000))
    rows = [(1, "a b c d e f g h i j k l m n", "en", "s", 1), (1, "a b c d e f g h i j k l m n", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \t\n ", "en", None, 3), (5, long, "en", "t", 1), (6, long + " tail", "en", "t", 1), (None, "a b c", None, "s", 1), (7, "one", "xx", "é", 1), (8, "stupid idiot é \U0001f600 A-B", "en", "", 1)]
    return spark.createDataFrame([(*r, 0.5, 1, "c", "h", 1, 2) for r in rows], ODD)
