import pytest


@pytest.fixture
def docs(spark):
    """Rows with ties, repeats, nulls, empty and long texts, and columns whose names clash with the operators' own."""
    near = [f"w{i}" for i in range(60)]
    other = list(near)
    other[30] = "changed"
    rows = [
        (1, " ".join(near)),
        (2, " ".join(near)),
        (3, " ".join(other)),
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "Two words"),
        (8, "two  words"),
        (9, "été 日本 naïve\x0bx"),
        (10, " ".join(f"v{i % 997}" for i in range(30_000))),
        (11, "x" * 5000),
        (12, "under the MIT License and under the mit-license"),
        (2, " ".join(near)),
        (13, " ".join(near[5:40])),
    ]
    return spark.createDataFrame([(i, t, "en", "s", 1, 0, "k", True) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, token string, kept boolean")


@pytest.fixture
def empty(docs):
    return docs.limit(0)


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}
