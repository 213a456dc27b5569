import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent.parent))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, host string, _text string, size bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


#: Nulls in any column, empty, blank and long texts, ties, repeated rows, and extra columns with clashing names.
ODD = [
    (1, prose(1, 80), "en", "a"),
    (2, prose(1, 80), "en", "a"),
    (2, prose(1, 80), "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, "b"),
    (5, " \t\n ", "de", None),
    (None, prose(2, 70), "en", "b"),
    (None, None, None, None),
    (6, "x", "en", "a"),
    (7, "naïve ▁ text 漢字 \U0001f600 " + prose(3, 60), "fr", "c"),
    (8, prose(4, 30_000), "en", "a"),
    (9, "a" * 5000, "en", "a"),
    (10, "same line here\n" * 40, "en", "a"),
    (11, "### *** " * 60, "en", "a"),
    (2, prose(5, 60), "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), 0.5, "h", "clash", 3) for i, t, lang, s in ODD]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0), (8, 1, 0), (11, 0, 0), (10, 0, 1), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
