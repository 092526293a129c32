import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, keep_id long, h long, _key string, _at long, _score double, _sha string, _id long, key string, fp long"


def make(spark, rows):
    """Documents with extra columns whose names clash with those the operators use inside."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", 7, 1, "k", 2, 0.5, "z", 3, "y", 4) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, nulls, empties, one very long text, odd white space, a hot source."""
    rng = random.Random(3)
    base = [words(rng, rng.randrange(3, 160)) for _ in range(60)]
    passage = words(rng, 50, 5000)
    rows = []
    for i in range(150):
        text = base[rng.randrange(60)] if i % 3 else words(rng, rng.randrange(1, 200))
        if i % 7 == 0:
            text = f"{words(rng, 20)} {passage}\n{words(rng, 30)}"
        if i % 11 == 0:
            text = text.replace("w1", "W1", 1) + "  \t" + words(rng, 1)
        if i % 13 == 0:
            text = text.replace(" ", "\n", 3)
        rows.append((i * 3, text, "hot" if i % 3 == 0 else f"s{i % 5}"))
    rows += [(1, None, None), (2, "", "hot"), (4, " \t ", "s1"), (5, words(rng, 9000, 3000), "s2"), (7, "Ünï çödé", "s3"), (8, "a", "s3"), (10, "a b c", "s3")]
    rows += [(rows[5][0] + 1, rows[5][1], "s0")] * 2  # repeated rows
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
