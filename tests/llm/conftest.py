import random
import string

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """A documents table from (doc_id, text) pairs."""

    def make(pairs):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], DOCUMENTS)

    return make


def word_text(seed, n, size=400):
    """n words of a vocabulary of `size` invented words."""
    r = random.Random(7)
    words = ["".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 9))) for _ in range(size)]
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture
def words():
    return word_text
