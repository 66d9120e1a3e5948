import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, language string, base string, node string, next string"


@pytest.fixture
def make_docs(spark):
    """Documents of (doc_id, text, lang, source), with columns whose names clash with inner ones."""

    def make(rows):
        full = [(i, t, lang, s, len(t or ""), "x", "x", "x", "x") for i, t, lang, s in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture
def prose():
    """A maker of made-up prose: prose(words, seed, letters)."""

    def make(n, seed, letters="aeiounrstlmdh"):
        r = random.Random(seed)
        words = ["".join(r.choices(letters, k=r.randint(2, 8))) for _ in range(n)]
        return " ".join(w + ("." if r.random() < 0.1 else "") for w in words)

    return make


@pytest.fixture
def awkward(prose):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = prose(30_000, 1)
    return [
        (1, prose(80, 2), "en", "a"), (1, prose(80, 2), "en", "a"), (2, None, None, None), (3, "", "en", "a"),
        (4, "   \n\t ", "de", None), (5, long, "en", "b"), (None, prose(40, 3), "fr", "b"), (None, None, None, None),
        (6, "one two", "en", "c"), (7, "é中\U0001f600 \n\n\n x", "??", "c"), (8, long, "en", "a"), (9, prose(80, 2), "en", "d"),
    ]
