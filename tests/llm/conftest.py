import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, _k1 int, kept string"


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, near copies, shared passages; columns with clashing names."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, base = text(80), text(300)
    near = base.split(" ")
    near[150] = "changed"
    texts = [None, "", "   \n\t", "x", base, base, " ".join(near), text(60) + "\n" + shared, shared + "\n" + text(40), "a a a a a " * 60, text(20000), text(20000) + shared, "end ▁▁  two\x00　 \U0001f600"]
    texts += [text(70) for _ in range(8)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), None if t is None else len(t), "clash", 7, "clash") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[7], None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
