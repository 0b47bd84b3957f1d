import random

import pytest

WORDS = "the of and to in is that it was for on are as with his they at be this from or had by hot but some what there we can out other".split()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, copies, and columns with clashing names."""
    rng = random.Random(4)
    long_text = " ".join(rng.choices(WORDS, k=30_000))
    shared = " ".join(rng.choices(WORDS, k=40))
    rows = [
        (1, None, None, None, None, 1), (2, "", "en", "a", 0, 1), (3, " \t\n ", None, "b", 3, 1), (4, long_text, "en", None, 5, 1),
        (5, shared, "en", "a", 1, None), (6, shared, "en", "a", 1, 2), (7, "x " + shared + " y", "fr", "a", 1, 2), (8, "one", "de", "c", 1, 2),
        (9, "é 𝔘 ß", "de", "c", None, 2), (None, shared, "en", "a", 1, 3), (None, None, None, None, None, 3), (6, shared, "en", "a", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
