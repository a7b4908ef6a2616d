import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{k % 977} and" for k in range(30_000))
    rows = [(1, "plain words here", "en", "a", 16), (2, None, None, None, None), (None, "no id of its own", "en", "a", 3), (3, "", "en", "a", 0), (4, "  ", "fr", "b", 2), (5, long, "en", "a", len(long))]
    rows += [(1, "plain words here", "en", "a", 16)] * 2 + [(6, "é ß 日本語 <|endoftext|> x\n\n y  z", "de", "b", 20)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 as id", "2 as nth", "3 as length", "'x' as key", "0.5 as score", "4 as part", "5 as kept_lang")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def prose():
    """Texts of an invented language; seeded."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choices(["the", "an", "er", "in", "on", "tion", "ed", "ha", "st", "ou"], k=rng.randint(1, 4))) for _ in range(3000)]

    def text(n):
        return " ".join(rng.choices(words, k=n))

    return text
