import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def docs_of(spark):
    """Documents from texts, ids from 0; a pair gives id and text."""

    def make(*texts):
        rows = [(t[0], t[1]) if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", 1, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id long")

    return make
