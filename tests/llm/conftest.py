import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture
def odd_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, null and repeated ids, clashing extra columns."""
    rows = [
        (1, prose(1, 60), "en", "a"),
        (2, None, "en", None),
        (3, "", None, "a"),
        (4, prose(4, 30_000), "en", "b"),
        (5, prose(1, 60), "fr", "b"),
        (6, "é ü 日本語 \t\x0b ##", "fr", "a"),
        (7, "   \n\n ", "en", "a"),
        (8, prose(8, 3), "en", "a"),
        (8, prose(8, 3), "en", "a"),
        (8, prose(9, 5), "de", "a"),
        (None, prose(10, 40), "en", "c"),
        (None, None, None, None),
    ]
    rows = [(*r, len(r[1] or ""), "x", 0.5, 7) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double, size int")


@pytest.fixture
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
