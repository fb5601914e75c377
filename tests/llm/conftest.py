import pytest
from pyspark.sql import DataFrame

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents frame from (doc_id, text) pairs."""

    def make(rows) -> DataFrame:
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def words():
    import numpy as np

    def make(seed: int, n: int) -> str:
        rng = np.random.default_rng(seed)
        return " ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n))

    return make
