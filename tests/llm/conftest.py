import random

import pytest

DOCS = "doc_id long, text string, node long, digest string, score double, lang string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    """Null, empty and very long texts, equal and near texts, repeated rows, a null id; columns with clashing names."""
    rng = random.Random(11)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), words(rng, 120), None, "", "", " \n ", "one", "one", words(rng, 20000), "two words", base.upper(), "ß İ Σ 日本 \x1c x", "a " * 300]
    rows = [(i, t, 7, "d", 0.5, "en") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[3], (None, "no id", 1, "x", 0.0, "en"), (None, None, 1, "x", 0.0, None)]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
