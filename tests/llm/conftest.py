import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, id string, row string, doc string, fp string, part string, chunk string, pii string, `Text_SHA256` string, host string, path string, keep_id string, fingerprint string"


@pytest.fixture
def docs(spark):
    """Documents with columns whose names clash with those that operators add, from a list of texts or (id, text)."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        filled = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"src{k % 2}", None, *(["x"] * 13)) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(filled, SCHEMA).repartition(3)

    return make


@pytest.fixture
def odd():
    """Nulls, empty and blank texts, repeats, repeated ids, a null id, a long text and one without white space."""
    return [(0, None), (1, ""), (2, ""), (3, " \n\t"), (4, "One two three four."), (5, "One two three four."), (5, "One two three four."), (6, "a"), (None, "null id here, one two three"), (7, "word " * 20_000), (8, "ab" * 40_000), (9, "Ünïcødé 漢字 😀 ́x <|endoftext|> it's")]
