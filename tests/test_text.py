import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import ENGLISH_STOPWORDS, jaccard, resolve_stopwords, tokenise


def tokens(spark, texts, *args, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["t"] for r in df.select("i", tokenise(F.col("text"), *args, **options).alias("t")).orderBy("i").collect()]


def test_micro_cases(spark):
    cases = {
        "state-of-the-art well-known": ["state", "art", "well", "known"],
        "test 123 word42": ["test", "123", "word42"],
        "a b c d": [],
        "!!!": [],
        "": [],
        "The\tquick\nfox": ["quick", "fox"],
        "café naïve résumé": ["café", "naïve", "résumé"],
        "snake_case x_1": ["snake_case", "x_1"],
    }
    assert tokens(spark, list(cases)) == list(cases.values())


def test_null_is_empty(spark):
    assert tokens(spark, [None]) == [[]]


def test_stopword_options(spark):
    assert tokens(spark, ["The the fish"], None) == [["the", "the", "fish"]]
    assert tokens(spark, ["The the fish"], {"fish"}) == [["the", "the"]]
    assert tokens(spark, ["The the fish"], lowercase=False) == [["The", "fish"]]
    assert resolve_stopwords("English") == ENGLISH_STOPWORDS and len(ENGLISH_STOPWORDS) == 33
    with pytest.raises(ValueError):
        resolve_stopwords("klingon")


def test_repeats_survive_the_filter(spark):
    assert tokens(spark, ["fox the fox fox"]) == [["fox", "fox", "fox"]]


def test_same_as_python(spark):
    texts = ["Zwei Straßen, größer; naïve façade — 42km", "x yy zz ab", "ALL CAPS and_more-than one"]
    assert tokens(spark, texts, None) == [re.findall(r"\b\w\w+\b", t.lower()) for t in texts]


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(jaccard(F.col("x"), F.col("y"))).collect()] == [pytest.approx(1 / 3), 1.0]
