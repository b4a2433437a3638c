import random

import pytest

#: Columns that operators use inside, as extra columns of the input.
EXTRA = "kept boolean, size long, row long, digest string, component_id long, shard int, found string, part int, n long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def prose(rng, n, words=None):
    pool = words or ["alpha", "beta", "Gamma", "delta,", "été", "straße", "the", "of", "river", "stone", "cloud", "near", "über", "niño", "seven"]
    out = []
    for i in range(n):
        out.append(rng.choice(pool) + str(rng.randint(0, 99)))
        if rng.random() < 0.08:
            out[-1] += "."
    text = " ".join(out)
    return text.replace(". ", ".\n")


def make_rows(seed=1, n=60):
    rng = random.Random(seed)
    texts = [None, "", " ", "\n\n", "one", "One", "ONE", "ÉTÉ", "été", "a b", "A b", "x" * 5000, "word " * 3000, prose(rng, 4000)]
    texts += [prose(rng, rng.randint(20, 160)) for _ in range(n)]
    texts += [texts[-1], texts[-1].upper(), texts[-2] + " more", texts[-3].replace("the", "The")]
    base = texts[-10].split(" ")
    for i in range(6):  # near copies
        w = list(base)
        w[(7 * i) % len(w)] = f"changed{i}"
        texts.append(" ".join(w))
    rows = [(i, t, "en", f"src{i % 5}", len(t or ""), True, i, i, "d", i, 1, "f", 2, 3) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "null id text", None, None, None, None, None, None, None, None, None, None, None, None), (rows[21][0], "same id, other text", *rows[21][2:])]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
