"""Small corpora with every kind of odd row."""

import random

import pytest

WORDS = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ly"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): null and empty texts, blanks, ties, repeats, long and non-Latin texts, control characters."""
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "two words", "Three WORDS here", "three words HERE", sentence(rng, 60), sentence(rng, 9000)]
    texts += ["ünïcödé ñandú 漢字 😀 \x00 \x1c x", "|".join("abc"), "#" * 50, "a " * 300, "\n".join(["same line here ."] * 9), "x" * 20_000]
    base = sentence(rng, 200).split()
    for k in range(6):
        copy = list(base)
        copy[17 * k + 3] = f"edit{k}"
        texts.append(" ".join(copy))
    rows = [(k, t) for k, t in enumerate(texts)]
    return [*rows, rows[7], rows[8], (None, "no id at all"), (900, texts[7])]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """With the other columns of documents, and some whose names operators use inside."""
    rows = [(i, t, [None, "en", "de"][k % 3], [None, "s1", "s2", "s3"][k % 4], k, "x", "y", 1.0, "z") for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, component string, score double, TOKENS string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
