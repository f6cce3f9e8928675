import pytest
from helpers import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, row_hash string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    a = prose(1, 60)
    rows = [(1, a), (2, a), (2, a), (3, prose(2, 50)), (None, None), (None, a), (4, ""), (5, None), (6, " \t\n"),
            (7, prose(3, 30000)), (8, "one"), (9, "Ünï ©ode 日本語 '’s"), (10, "x" * 50000)]
    return [(i, t, "en", None, None if t is None else len(t), 0.5, 1, "x") for i, t in rows]


@pytest.fixture
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (1, 0, 0), (3, 0, 0), (7, 1, None), (None, 1, 1), (99, 0, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
