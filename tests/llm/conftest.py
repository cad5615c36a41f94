import pytest

from leasemill.llm.store import shipped

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def _package(spark):
    shipped(spark)


@pytest.fixture
def documents(spark):
    """A frame with the columns of documents from (doc_id, text) pairs, and a column whose name an operator might use itself."""

    def make(pairs, extra="score"):
        rows = [(i, t, "en", None, None, "x") for i, t in pairs]
        return spark.createDataFrame(rows, f"{DOCS}, {extra} string").repartition(3)

    return make
