import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, `key` int, a string, shard int, size string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source), with extra columns whose
    names the operators also use."""
    def of(rows):
        return spark.createDataFrame([(*r, 0, "n", 1, "a", 7, "s") for r in rows], SCHEMA)
    return of


def prose(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, a null id, null source and language, a long
    text, exact copies and repeated rows."""
    long = prose(20_000, 1, 5000)
    return [
        (1, prose(60, 2), "en", "s1"), (2, None, "en", "s1"), (3, "", "de", "s2"), (4, " \t\n", "de", None),
        (None, prose(60, 2), "en", "s1"), (5, long, "fr", "s2"), (6, long, "fr", "s2"),
        (7, prose(40, 3), None, None), (7, prose(40, 3), None, None), (8, "one", "es", "s3"),
        (9, "Ünï Ж", "en", "s3"), (10, prose(40, 3), "en", "s1"),
    ]
