import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source), with a column whose name may clash."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x") for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
        return spark.createDataFrame(full, schema)

    return make
