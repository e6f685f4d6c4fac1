import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) rows, with columns whose names the operators use inside."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), 1, "x", 2, 3.0) for i, t in rows]
        return spark.createDataFrame(full, COLUMNS + ", key int, found string, h int, component_id double")

    return make


@pytest.fixture
def plain(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS)

    return make
