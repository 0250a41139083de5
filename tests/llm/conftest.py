import random

import pytest

from delayspark.llm.common import ship

SF = "/root/testdata/sf0.001"
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, "
        "size long, key string, fp long, kept boolean, n_words long, bucket int, target double, taken long, rank int")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}x" for _ in range(n)]


def edge_texts():
    """Null, empty, blank, short, long, repeated, tied and odd texts."""
    rnd = random.Random(9)
    base = " ".join(words(rnd, 80)) + "."
    long = " ".join(words(rnd, 30_000)) + "."
    return [None, "", " \n\t ", "one", "Two words.", base, base, base + " tail.", base.upper(), long,
            "á é ñ ü ß — 日本語 テキスト\u3000全角。", "a\nb\na\n\nb\n", "home | about | contact | us", "x " * 500,
            "1234567890123456 " * 3, "<|endoftext|> token = \"0123456789abcdef0123456789abcdef01234567\" end."]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge texts with null ids and sources, repeated rows, and extra columns whose names clash."""
    rows = []
    for i, t in enumerate(edge_texts()):
        rows.append((None if i == 3 else i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}",
                     None if t is None else len(t), 1, "k", 2, None, 3, 4, 5.0, 6, None))
    rows += rows[5:8] + rows[:2]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
