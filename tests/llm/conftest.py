import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with extra columns whose names clash with the ones the
    operators use inside, dealt to several partitions."""

    def build(rows):
        schema = "doc_id long, text string, lang string, row long, words long, n long, score double"
        return spark.createDataFrame([(k, t, None, 1, 2, 3, 0.5) for k, t in rows], schema).repartition(3)

    return build
