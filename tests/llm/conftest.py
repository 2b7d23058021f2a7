import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __x string, words string"


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, and two columns that operators don't know."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "é", "ñ", "st", "re"]) for _ in range(rng.randint(1, 4)))
    prose = lambda k: " ".join(word() + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(k))
    shared = [prose(60) for _ in range(3)]
    texts = []
    for k in range(n):
        t = prose(rng.randint(1, 160))
        if k % 5 == 0:
            t = t[: len(t) // 2] + " " + rng.choice(shared) + " " + t[len(t) // 2 :]
        if k % 7 == 0 and texts:
            t = rng.choice([x for x in texts if x])
        if k % 11 == 0 and texts:
            own = rng.choice([x for x in texts if x]).split(" ")
            own[rng.randrange(len(own))] = "changed"
            t = " ".join(own)
        texts.append(t)
    texts += [None, "", " \n\t ", "x" * 5000, ("ab " * 3000).strip(), prose(4000), "aaaa" * 100 + " tail", "## $$ %%\n## $$ %%\n## $$ %%\n", "one\x1ftwo three  four", "<|endoftext|> a 'll don't  x"]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), len(t or ""), "x", "y") for k, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "doc_id").cache()


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Repeated rows, repeated ids with another text, and null ids."""
    more = [*rows, rows[3], rows[3], (5, "another text of the same id", "en", "s1", 1, "x", "y"), *((None, r[1], *r[2:]) for r in rows[8:11])]
    return spark.createDataFrame(more, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
