import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length int, score string"


@pytest.fixture(scope="session")
def docs(spark):
    """Build documents with extra columns whose names clash with the operators' own."""

    def build(rows):
        full = []
        for i, text, *more in rows:
            lang, source = more[0] if more else (None, None)
            full.append((i, text, lang, source, None if text is None else len(text), 1, "x"))
        return spark.createDataFrame(full, DOCS)

    return build
