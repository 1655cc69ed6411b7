from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, toxic int, shard int, __digest string, id int, key string, words int, h0 int"


def frame(spark, rows):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, source, None, "d", 7, 8, "x", 9, "k", 3, 4) for i, t, lang, source in rows], SCHEMA)


LONG = " ".join(f"word{i} of that" for i in range(60_000))
HARD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta.", "en", "a"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta.", "en", "a"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta.", "en", "a"),
    (3, "", "en", "a"),
    (4, "", "de", None),
    (5, None, None, None),
    (6, None, "fr", "b"),
    (None, "lonely text without a number", "en", "b"),
    (None, None, None, "b"),
    (7, LONG, "en", "b"),
    (8, "Alpha beta gamma delta epsilon zeta eta theta.", "de", "b"),
    (9, "  \n\t ", "en", "a"),
]


@pytest.fixture(scope="session")
def hard(spark):
    return frame(spark, HARD).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
