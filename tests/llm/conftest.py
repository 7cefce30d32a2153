import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passage(seed, n):
    rng = random.Random(seed)
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi om pi rho tau".split()) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages, repeats inside a text, short, empty, null, unspaced and long texts."""
    base, shared, rng = passage(1, 120), passage(2, 30), random.Random(5)
    near = [" ".join(w if i != 10 + k else "changed" for i, w in enumerate(base)) for k in range(5)]
    long = " ".join(passage(3, 6000))
    out = [
        " ".join(base), " ".join(base), *near, " ".join(passage(4, 50) + shared + passage(5, 9)), "x " + " ".join(shared) + " y",
        " ".join(shared + shared), "a b c", "a b c", "A B  c", "", None, " \n\t ", "one", "é\u00a0ß " * 30, "\u4f60\u597d" * 40,
        "ab" * 3000, long, long[: len(long) // 2], "Same line of the page, repeated here.\nSame line of the page, repeated here.\nOther",
        "Same line of the page, repeated hero.\nshort\nshort", "don't.Stop <|endoftext|> it's X1. 42\x1c7!!!",
        "password = hunter2hunter2 and token: \"abc\" AKIA" + "A1B2C3D4E5F6G7H8 " + "deadbeef" * 4,
    ]
    for k in range(12):
        out.append(" ".join(passage(100 + k, rng.randrange(1, 70))))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts, with columns named like those of results, and one row repeated."""
    rows = [(i, t, "en" if i % 3 else None, "s", 1) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([*rows, rows[7]], SCHEMA).repartition(3)
    return frame.selectExpr("*", "1 as id", "2 as n", "3 as start", "4 as k", "'z' as rest", "5 as score")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
