import random

import pytest
from pyspark.sql import functions as F

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared lines, nulls, empty and long texts, repeated rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(400)]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k)).capitalize() + "."
    shared = [line(14), line(20)]
    texts = []
    for i in range(n):
        own = [line(r.randint(3, 40)) for _ in range(r.randint(1, 6))]
        if i % 5 == 0:
            own.insert(r.randint(0, len(own)), r.choice(shared))
        if i % 7 == 3 and texts:
            w = r.choice(texts).split(" ")
            for _ in range(max(1, len(w) // r.choice([12, 30, 80]))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            own = [" ".join(w)]
        texts.append(r.choice(texts) if i % 11 == 10 else "\n".join(own))
    texts += [None, "", " \t\n", "One", "two words", " ".join(vocabulary * 12), "é ü 語", "\x00 odd ▁ text"]
    rows = [(i, t, None if i % 9 == 8 else "en", "s", 1) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[3], (None, "no id here at all, none", "en", "s", None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, TABLE).withColumns({"score": F.lit("clash"), "id": F.lit("clash")}).cache()


@pytest.fixture(scope="session")
def empty(documents):
    return documents.where("false")
