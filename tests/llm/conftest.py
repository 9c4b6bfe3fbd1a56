import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with names that operators use inside."""
    words = " ".join(f"w{k}" for k in range(90))
    rows = [
        (1, words), (2, words), (3, words.replace("w45", "z")), (4, ""), (5, None), (6, "   \n\t "), (7, "one two"), (8, "One  two"), (9, "é" * 3), (10, " ".join(f"l{k % 5000}" for k in range(60_000))),
        (11, words), (11, words), (None, words), (None, None), (12, "a" * 200_000), (13, "x y z x y z x y z " * 40),
    ]
    rows = [(*r, "k", 1, "i", "s", 2.0) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n int, id string, sig string, score double")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string, n int, id string, sig string, score double")
