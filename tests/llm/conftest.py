import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) rows with extra columns, as a frame."""

    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as key", "1 as value")

    return make
