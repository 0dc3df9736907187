import random

import pytest

UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, id string, h string, n_tokens string, component string, tree int"


def rows_of(docs):
    """(doc_id, text, source) as full rows, with columns whose names clash with the operators' own."""
    return [(i, t, "en", s, None if t is None else len(t), False, -1, "x", "y", "z", "w", 7) for i, t, s in docs]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows."""
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "épsilon", "zeta", "eta", "theta", "Iota", "kappa"]
    long = " ".join(rnd.choice(words) + str(rnd.randrange(500)) for _ in range(40_000))
    near = long.split()
    near[100] = "changed"
    docs = [(0, "Hello  World", "a"), (1, "hello  world", "a"), (2, None, None), (3, "", "b"), (4, None, "b"), (5, "É é", "b"), (6, "é é", "c"), (7, long, "c"), (8, " ".join(near), "c"), (9, long.translate(UPPER), None)]
    docs += [(10, "one two three four", "a"), (10, "one two three four", "a"), (None, "one two three four", "a"), (None, None, None), (11, "\n\n a \nB\r\n", "b"), (12, "x", "a"), (13, "the same line\nown 13", "a")]
    docs += [(20 + i, f"The same line \nown {i}\n", "d") for i in range(12)]
    return spark.createDataFrame(rows_of(docs), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_frame(spark, docs, parts=3):
    return spark.createDataFrame(rows_of(docs), SCHEMA).repartition(parts)
