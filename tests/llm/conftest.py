import pytest


@pytest.fixture(autouse=True)
def _shipped(spark):
    from verbatim.llm.common import ship

    ship(spark)


@pytest.fixture()
def docs(spark):
    """Rows of (doc_id, text, source), with columns whose names the operators use themselves."""

    def make(rows):
        schema = "doc_id long, text string, source string, score string, row int, id string, component long, size string, words int"
        full = [(*r, *(None,) * (3 - len(r)), "x", 1, "y", 7, "z", 3) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
