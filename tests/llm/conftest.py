import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h long"


def corpus(seed=5):
    """Documents with every awkward case: nulls, empties, long texts, ties, copies, near copies, shared passages, repeats inside a text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = prose(70)
    texts = [None, "", " \t\n ", "one", "Two words", " nbsp em", "a" * 500, "ab" * 400, "é" * 300]
    texts += [prose(rng.randint(5, 200)) for _ in range(25)]
    texts += [texts[10], texts[10], texts[12], texts[12].upper()]
    texts += [prose(30) + " " + passage + "\n" + prose(20), passage, prose(5) + "\n" + passage + " " + prose(60), passage + " " + passage]
    near = prose(300)
    for i in range(6):
        w = near.split()
        w[40 * i + 3] = "changed%d" % i
        texts.append(" ".join(w))
    texts.append(prose(6000) + "\n" + near)
    texts.append("x\ty\x0bz\x0c w\r\n" + passage.replace(" ", "  "))
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t, rng.choice(["en", "fr", None, "xx"]), "s%d" % (i % 3), None if t is None else len(t), 0.5, i) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[20], (None, passage + " tail", "en", None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
