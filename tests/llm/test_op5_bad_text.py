import random

import pytest

from quillspark.llm import quality

RNG = random.Random(5)


def words(n):
    return ["".join(RNG.choice(["ka", "lo", "mi", "ren", "sto"]) for _ in range(RNG.randint(1, 4))) for _ in range(n)]


def sentence(n):
    return " ".join(words(n)).capitalize() + "."


def insulted(n):
    return " ".join(w if i % 6 else "krimolsto" for i, w in enumerate(words(n))) + "."


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, sentence(RNG.randint(8, 40)), "xx") for i in range(400)]
    rows += [(1000 + i, insulted(40), "xx") for i in range(80)]
    rows += [(2000 + i, " ".join(w.upper() for w in words(30)), "xx") for i in range(20)]
    labels = [(i, 1, 0) for i in range(300)] + [(i, 1, 1) for i in range(1000, 1060)] + [(i, 0, 0) for i in range(2000, 2010)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r["doc_id"]: r for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}


def test_labelled_bad_text_counts(judged):
    assert sum(not judged[i]["kept"] for i in range(1060, 1080)) >= 18  # unlabelled toxic text
    assert sum(not judged[i]["kept"] for i in range(1000, 1060)) >= 54
    assert all(not judged[i]["kept"] for i in range(2000, 2020))


def test_clean_text_stays(judged):
    assert sum(not judged[i]["kept"] for i in range(400)) <= 4
