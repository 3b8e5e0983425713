import pytest
from edge_cases import edge_rows


@pytest.fixture(scope="session")
def edges(spark):
    """The rows with more columns whose names clash with those of results."""
    schema = "doc_id long, text string, lang string, score double, n_words int, key string, doc string, kept string, token string"
    return spark.createDataFrame([(i, t, "en", 0.5, 1, "k", "d", "x", "t") for i, t in edge_rows()], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in list(range(1, 50)) if i != 6] + [(1, 0, 0), (None, 1, 1), (13, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
