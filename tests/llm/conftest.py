import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon Größe été ñu".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows with nulls, empty and long texts, ties, repeated rows, copies and shared passages."""
    rng = random.Random(11)
    passage = prose(rng, 90)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(30)]
    rows += [(30 + i, f"{prose(rng, 5)}\n{passage}\n{prose(rng, 5)}") for i in range(8)]
    base = prose(rng, 200).split()
    for i in range(8):
        edited = list(base)
        edited[5 + i] = "EDIT"
        rows.append((40 + i, " ".join(edited)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, None), (53, ""), (54, " \n\t "), (55, "x"), (None, rows[4][1]), (None, None), (56, "ab" * 3000), (57, "ein zwei drei"), (58, "EIN zwei  drei"), (60, prose(rng, 4000)), (60, prose(rng, 4)), (61, "same"), (61, "same")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", "s0", len(t or ""), 7, "clash") for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long, score int, spans string").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
