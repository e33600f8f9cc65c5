import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, seg int, bucket string, key long, id string, lens int, cls string, shard int, root string"
WORDS = "the of and to in is it that was for on are as with his they at be this from or had by hot word but what some we can out other were all there when up use your how said an each she".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    shared = prose(rng, 70)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randrange(1, 160))
        if i % 7 == 3:
            text = text + " " + shared + ". " + prose(rng, 5)
        if i % 11 == 5 and rows:
            text = rows[i // 2][1]
        if i % 13 == 6 and rows and rows[i // 2][1]:
            w = rows[i // 2][1].split()
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        rows.append([i, text])
    rows[10][1], rows[20][1], rows[21][1], rows[22][1] = None, "", "   \n\t", "!!! ???"
    rows[30][1] = prose(rng, 30000)
    rows[31][1] = "a" * 5000
    rows[32][1] = "ÉÀ naïve 東京 мир " * 9 + "A" * 60
    rows.append(list(rows[4]))
    rows.append([5, "another text under a used id"])
    rows.append([None, rows[6][1]])
    rows.append([None, None])
    langs = ["en", "de", None]
    return [(i, t, langs[k % 3], None if k % 9 == 0 else f"src{k % 4}" if k % 2 else "src0", len(t or ""), 1, "x", 2, "y", 3, "z", 4, "r") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
