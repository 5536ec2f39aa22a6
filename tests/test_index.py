"""All 25 method pairs, and the edges, against a separate NumPy scorer."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.scoring import METHODS, score_idf, score_tfc
from quillspark.operators import index as ix
from quillspark.operators import retrieve as rt
from quillspark.operators.vocab import build_vocab, encode, id_to_token

DOCS = [["the", "quick", "brown", "fox"], ["the", "lazy", "dog", "sleeps"], ["a", "quick", "fox", "jumps", "over", "the", "lazy", "dog"], ["brown", "fox", "fox", "fox"], []]
QUERIES = [["fox"], ["lazy", "dog", "dog"], ["the", "zebra"]]


def np_tfc(method, tf, l_d, l_avg, k1, b, delta):
    norm = 1 - b + b * l_d / l_avg
    if method in ("robertson", "lucene"):
        return tf / (k1 * norm + tf)
    if method == "bm25l":
        c = tf / norm
        return (k1 + 1) * (c + delta) / (k1 + c + delta)
    return (k1 + 1) * tf / (k1 * norm + tf) + (delta if method == "bm25+" else 0)


def np_idf(method, df, n, negative=False):
    odds = (n - df + 0.5) / (df + 0.5)
    return {
        "robertson": lambda: math.log(odds if negative else max(odds, 1)),
        "lucene": lambda: math.log(1 + odds),
        "atire": lambda: math.log(n / df) if df else math.inf,
        "bm25l": lambda: math.log((n + 1) / (df + 0.5)),
        "bm25+": lambda: math.log((n + 1) / df) if df else math.inf,
    }[method]()


def np_scores(method, idf_method, query, k1=1.5, b=0.75, delta=0.5):
    n, l_avg = len(DOCS), sum(map(len, DOCS)) / len(DOCS)
    df = Counter(t for d in DOCS for t in set(d))
    total = np.zeros(n)
    for i, d in enumerate(DOCS):
        for t in query:
            if t in df:
                tf = d.count(t)
                idf = np_idf(idf_method, df[t], n)
                if tf:
                    total[i] += np_tfc(method, tf, len(d), l_avg, k1, b, delta) * idf
                elif method in ("bm25l", "bm25+"):
                    total[i] += np_tfc(method, 0, l_avg, l_avg, k1, b, delta) * idf
    return total


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, tokens array<string>").persist()


@pytest.fixture(scope="module")
def terms(spark):
    return rt.query_terms(spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, tokens array<string>")).persist()


@pytest.mark.parametrize("method", METHODS)
def test_all_pairs(corpus, terms, method):
    for idf_method in METHODS:
        rows = rt.score(ix.build_index(corpus, ix.Config(method=method, idf_method=idf_method)), terms).collect()
        assert rows
        for r in rows:
            assert r["score"] == pytest.approx(np_scores(method, idf_method, QUERIES[r["query_id"]])[r["doc_id"]], abs=1e-9)


@pytest.mark.parametrize("method", METHODS)
def test_components(spark, method):
    cases = [(tf, df) for tf in (0, 1, 2, 3, 5, 7, 10) for df in (1, 3, 80, 100)]
    df = spark.createDataFrame(cases, "tf int, df int")
    rows = df.select("tf", "df", score_tfc(method, F.col("tf"), F.lit(20), F.lit(15.0), delta=1.0).alias("t"), score_idf(method, F.col("df"), F.lit(100), True).alias("i")).collect()
    for r in rows:
        assert r["t"] == pytest.approx(np_tfc(method, r["tf"], 20, 15, 1.5, 0.75, 1.0), abs=1e-9)
        assert r["i"] == pytest.approx(np_idf(method, r["df"], 100, True), abs=1e-9)


def test_idf_edges(spark):
    one = spark.range(1)
    value = lambda *a: one.select(score_idf(*a).alias("x")).first()["x"]
    assert value("atire", F.lit(0), F.lit(10)) == math.inf
    assert value("robertson", F.lit(80), F.lit(100)) == 0
    assert value("lucene", F.lit(1), F.lit(1)) == pytest.approx(math.log(1 + 0.5 / 1.5))
    with pytest.raises(ValueError):
        value("tfidf", F.lit(1), F.lit(1))


def test_vocab_order_and_codes(spark):
    docs = spark.createDataFrame([(0, "the quick brown fox".split()), (1, "quick brown dog".split()), (2, "lazy fox jumps".split())], "doc_id long, tokens array<string>")
    vocab = build_vocab(docs)
    assert [r["token"] for r in vocab.orderBy("token_id").collect()] == "the quick brown fox dog lazy jumps".split()
    other = spark.createDataFrame([(0, ["fox", "zebra"])], "doc_id long, tokens array<string>")
    assert [r["token_id"] for r in encode(other, vocab).orderBy("pos").collect()] == [3, -1]
    assert [r["token_id"] for r in encode(other, vocab, -99).orderBy("pos").collect()] == [3, -99]
    assert id_to_token(vocab, 5) == "lazy"
    with pytest.raises(IndexError):
        id_to_token(vocab, -1)


def test_pointers_with_a_term_nobody_uses(spark):
    vocab = spark.createDataFrame([("a", 0), ("ghost", 1), ("b", 2)], "token string, token_id int")
    counts = spark.createDataFrame([(0, 2), (2, 3)], "token_id int, df long")
    assert [tuple(r) for r in ix.column_pointers(vocab, counts).orderBy("token_id").collect()] == [(0, 0), (1, 2), (2, 2), (3, 5)]


def test_empty_documents_count(corpus):
    stats = ix.corpus_stats(corpus).first()
    assert stats["n_docs"] == 5 and stats["l_avg"] == 4.0
    none = ix.corpus_stats(corpus.where("false")).first()
    assert none["n_docs"] == 0 and none["l_avg"] == 0.0


def test_stemmers(spark):
    docs = spark.createDataFrame([(0, ["running", "runs"]), (1, ["bird"])], "doc_id long, tokens array<string>")
    tf = {(r["doc_id"], r["token"]): r["tf"] for r in ix.term_frequencies(docs, "porter").collect()}
    assert tf == {(0, "run"): 2, (1, "bird"): 1}
    tf = {(r["doc_id"], r["token"]): r["tf"] for r in ix.term_frequencies(docs, lambda w: w[0]).collect()}
    assert tf == {(0, "r"): 2, (1, "b"): 1}
