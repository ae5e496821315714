import random

import pytest

WORDS = "the of and to in is was for on with that blue red stone river house cloud tree idle quick".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(30)) if r.random() < 0.5 else "") for _ in range(n))


def messy_rows():
    """Null, empty, blank, tiny and very long texts, ties, repeats and near copies; ids out of order."""
    base = prose(1, 80)
    near = base.replace("the", "a", 1)
    rows = [(7, None, "en", "b"), (3, "", "en", "a"), (4, " \n\t ", "fr", None), (9, "One", "en", "a"), (8, "one two", "en", "a"), (10, base, "en", "b"), (11, base, "en", "b"), (12, near, "en", "a"), (12, near, "en", "a"), (2, prose(2, 30_000), "de", "c"), (5, prose(3, 50), "en", "b"), (6, prose(4, 50), "en", "Ä"), (1, base.upper() + " TAIL", "es", "b")]
    return rows + [(20 + i, prose(20 + i, 20 + i), "en", "ab"[i % 2]) for i in range(40)]


@pytest.fixture(scope="session")
def messy(spark):
    """The rows above with columns whose names clash with those that the operators use inside."""
    rows = [(*r, len(r[1] or ""), *range(len(r[1] or "") % 3, len(r[1] or "") % 3 + 8)) for r in messy_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid int, size int, h int, n int, bucket int, shard int, score int, key int").repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("false")
