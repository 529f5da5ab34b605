import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, langs=None, schema=DOCS):
        """Rows from texts; ids count up from 0."""
        rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, very long and repeated rows, and columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    texts = [None, "", " \t\n ", "one", long, long, "x" * 100_000, "the same line\nagain and again\n" * 3, "a b c d e f g", "a b c d e f g", "\n\n\n", "café É 漢字 😀"]
    rows = [(i, t, None if i % 3 == 0 else "en", None, None, "clash", 7, 1.5) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", None, None, "clash", 7, 1.5), (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, n bigint, score double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
