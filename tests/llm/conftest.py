import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def byte_bpe():
    return str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="session")
def word_bpe():
    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, spaces, long, repeated rows, and columns whose names clash with inner ones."""
    rows = [
        (1, "Plain words of English prose here and there.", "en", "row"), (2, None, "en", None), (3, "", None, "h"), (4, "   \n\t ", "de", "x"), (5, "word " * 60_000, "en", "x"),
        (6, "Ähnliche Wörter stehen überall.", "de", "x"), (6, "Ähnliche Wörter stehen überall.", "de", "x"), (7, "12 34 !!", None, "x"), (None, "No id at all.", "en", "x"), (8, "Plain words of English prose here and there.", "en", "x"),
    ]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, 2) for i, t, lang, s in rows], "doc_id long, text string, lang string, row string, n_chars long, fp int, id int")
