from __future__ import annotations

import pytest


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    from evidentry.session import ship_package

    ship_package(spark)


#: A row of every awkward kind; callers add their own.
LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns with clashing names."""
    rows = [(1, "alpha beta gamma delta epsilon zeta", "s", "x", 1), (1, "alpha beta gamma delta epsilon zeta", "s", "x", 1),
            (2, None, None, None, None), (None, "alpha beta", "s", None, 2), (None, None, None, None, None), (3, "", "s", "x", 0),
            (4, " \t\n ", "t", "x", 3), (5, LONG, "t", "x", 4), (6, "one", None, "x", 5), (6, "two words", "u", "x", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, `score` string, `rest` int")
