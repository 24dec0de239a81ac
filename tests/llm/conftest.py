import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text, ...) rows; missing columns are null."""

    def make(rows, columns="doc_id long, text string, lang string, source string, n_chars long"):
        width = len(columns.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], columns)

    return make
