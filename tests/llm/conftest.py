import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, norm string, h long, fp long, k string, row string, p double, toxic int, rate double, hit string, base string, x string"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text, lang, source) rows with columns whose names clash with inner ones."""

    def build(rows):
        full = [(*r, None if r[1] is None else len(r[1]), "id", "norm", 7, 7, "k", "row", 0.5, 3, 0.5, "hit", "base", "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty, very long, repeated and tied rows."""
    long = "word another line\n" * 30_000
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "en", None), (None, "Some text here", "en", "a"), (None, None, None, None), (4, long, "en", "b"), (5, "Same Text", "en", "a"), (6, "same text", "fr", "b"), (6, "same text", "fr", "b"), (7, "日本語 𝒳", "ja", "c")]
    return make(rows)


@pytest.fixture(scope="session")
def empty(make):
    return make([(1, "x", "en", "a")]).filter("false")
