import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n int, row long, score double, hash long, kept string, bucket int, component_id int"


def make_docs(seed=1, n=120):
    """Rows with nulls anywhere, empty and long texts, ties, near and exact copies, repeated rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(60)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60)) + ". " + " ".join(r.choice(vocabulary) for _ in range(9)) + "."
    rows = []

    def text():
        words = [r.choice(vocabulary) + r.choice(["", "", "", ".", ",", ".\n"]) for _ in range(r.randint(1, 120))]
        return r.choice([" ", "  ", " "]).join(words)

    for i in range(n):
        t = text()
        if i % 7 == 0:
            t = t + " " + passage + " " + text()
        if i % 11 == 0 and rows:
            t = rows[r.randrange(len(rows))][1]
        if i % 13 == 0 and t:
            t = t.upper()
        if i % 17 == 0 and t:
            t = t + " Released under the MIT License."
        rows.append((i, t, r.choice(["en", "fr", None]), r.choice(["a", "a", "a", "b", "c", None]), 1))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, "  \n\t ", "en", "b", 4), (n + 3, "!!! 123", "fr", "c", 7)]
    rows += [(n + 4, "word " * 9000, "en", "a", None), (n + 5, passage, "en", None, None), (None, "no id at all", "en", "a", 1), (None, None, None, None, None)]
    rows += [rows[3], rows[3], rows[n + 1], rows[n]]  # repeated rows
    extra = ("x", 1, 2, 0.5, 3, "k", 4, 5)
    return [(*row, *extra) for row in rows]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
