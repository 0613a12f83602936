import pytest

DOCS = "doc_id long, text string, lang string, id string, n long, key string"


@pytest.fixture
def docs(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def build(*texts, ids=None):
        rows = [(i, t, None, "x", 1, "k") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, DOCS)

    return build


@pytest.fixture(scope="session")
def sample(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()
