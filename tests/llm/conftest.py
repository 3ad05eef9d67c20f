import pytest

# Lengths, nulls, ties and repeats that every operator has to stand.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 4999}x{i % 3}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, equal rows, clashing and extra columns."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a.example.org", 1),
        (2, "alpha beta gamma delta epsilon zeta eta theta", None, None, None),
        (2, "alpha beta gamma delta epsilon zeta eta theta", None, None, None),
        (3, None, "en", "a.example.org", 0),
        (4, "", None, "b.example.com", 0),
        (5, LONG, "en", "a.example.org", None),
        (6, LONG + " tail", "en", "a.example.org", None),
        (None, "alpha beta", "de", None, None),
        (None, None, None, None, None),
        (7, "Été ñandú ß 日本語 \t\r\n  \x0b x\n\nline of ten chars\nLINE OF TEN CHARS  ", "fr", "", 3),
        (8, " line of ten chars\t", "xx", "http://u@Host.Example.DE:80/p?q", 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    # Names that operators use inside or return.
    return df.selectExpr("*", "1 AS did", "'x' AS th", "2 AS n", "3 AS row", "'k' AS kept", "0 AS tokens", "5 AS score")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


ODD_IDS = [1, 2, 2, 3, 4, 5, 6, 7, 8, None, None]
