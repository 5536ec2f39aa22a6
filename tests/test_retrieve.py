import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieve as rt
from quillspark.sources.binary import from_csc, read_vector, read_vocab, write_vector, write_vocab


def scores(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "doc_id long, score double")


@pytest.mark.parametrize("algorithm", ["heap", "quickselect"])
def test_top_k_global(spark, algorithm):
    got = rt.top_k_global(scores(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.5, 0.6, 0.7, 0.8, 0.9]), 6, algorithm=algorithm).collect()
    assert [r["doc_id"] for r in got] == [9, 8, 7, 6, 4, 5]
    assert [r["doc_id"] for r in rt.top_k_global(scores(spark, [1.0] * 50), 7, algorithm=algorithm).collect()] == list(range(7))


def test_top_k_checks(spark):
    for k in (0, -1, 3):
        with pytest.raises(ValueError):
            rt.top_k_global(scores(spark, [1, 2]), k)
    with pytest.raises(ValueError):
        rt.top_k_global(scores(spark, [1, 2]), 1, algorithm="bogo")


def test_score_matrix_by_hand(spark):
    matrix = from_csc(spark, [1.0, 2.0, 3.0, 0.5, 1.5], [0, 2, 1, 0, 1], [0, 2, 3, 5, 5])
    run = lambda ids: {r["doc_id"]: r["score"] for r in rt.score_matrix(matrix, spark.createDataFrame([(0, t) for t in ids], "query_id int, token_id int"), 4).collect()}
    assert run([0, 2]) == {0: 1.5, 1: 1.5, 2: 2.0}
    assert run([0, 0]) == {0: 2.0, 2: 4.0}
    assert run([]) == {} and run([3]) == {}
    for bad in ([4], [-1]):
        with pytest.raises(IndexError):
            run(bad)
    with pytest.raises(ValueError):
        rt.score_matrix(matrix.withColumn("score", F.col("score").cast("double")), spark.createDataFrame([(0, 0)], "query_id int, token_id int"), 4)


def test_priors_add_up(spark):
    priors = spark.createDataFrame([(0, 10.0), (1, 100.0), (2, 1.0)], "doc_id long, prior double")
    got = rt.add_priors(priors, scores(spark, [0.5, 0.25])).orderBy("doc_id").collect()
    assert [r["score"] for r in got] == [10.5, 100.25, 1.0]


def test_int32(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.range(1).select(rt.to_int32(F.lit(1 << 40))).collect()


def test_padded_and_collected(spark):
    hits = spark.createDataFrame([(0, 1, 7, 2.0)], "query_id long, rank long, doc_id long, score double")
    queries = spark.createDataFrame([(0,), (1,)], "query_id long")
    assert [tuple(r) for r in rt.padded(hits, queries, 2).orderBy("query_id", "rank").collect()] == [(0, 1, 7, 2.0), (0, 2, 0, 0.0), (1, 1, 0, 0.0), (1, 2, 0, 0.0)]
    assert [tuple(r) for r in rt.collected(hits, queries).orderBy("query_id").collect()] == [(0, [7], [2.0]), (1, [], [])]


def test_binary_codecs():
    assert read_vector(write_vector([1.0, -2.5], "f"), "f") == [1.0, -2.5]
    assert read_vocab(write_vocab(["café", "", "x"])) == ["café", "", "x"]
    for bad in (b"\x01", write_vocab(["ab"])[:-1], write_vocab(["ab"]) + b"!"):
        with pytest.raises(ValueError):
            read_vocab(bad)
    with pytest.raises(ValueError):
        read_vector(b"abc", "f")
