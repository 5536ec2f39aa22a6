"""Steps whose tasks must stay small on large tables: nothing is gathered in one task, and the results are the same."""

import json
from collections import Counter

import pytest

from quillspark.operators import index as ix
from quillspark.operators import retrieve as rt
from quillspark.operators.vocab import build_vocab
from quillspark.plans import interface
from quillspark.sources import jsonl


def test_lines_are_written_and_numbered_in_several_tasks(spark, tmp_path):
    n = 4000
    spark.range(n).selectExpr("id AS doc_id", "concat('w', id) AS text").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = interface.lines_of(spark, str(tmp_path), "documents", "doc_id")
        assert len(spark.read.text(folder).inputFiles()) > 1
        found = interface.jsonl_records(spark, str(tmp_path)).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert [(r["ordinal"], r["_id"]) for r in found] == [(i, str(i)) for i in range(n)]


def test_records_are_numbered_by_file_name_and_line(spark, tmp_path):
    """Spark reads larger files first, and a file of several splits in several tasks."""
    texts = [[f"{f} {i} {'x' * 200 * f}" for i in range(5 + 60 * f)] for f in range(3)]
    for f, rows in enumerate(texts):
        (tmp_path / f"part-{f}.json").write_text("\n\n".join(json.dumps({"_id": f"{f}-{i}", "text": t}) for i, t in enumerate(rows)) + "\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        found = jsonl.read_corpus(spark, str(tmp_path)).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert [(r["doc_id"], r["text"]) for r in found] == list(enumerate(t for rows in texts for t in rows))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


ODD = [(1, ["b", "a'b\\c", "b", "é"]), (2, []), (-3, ["a'b\\c"] * 3 + ["zz", "b"])]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, tokens array<string>")


def test_terms_are_counted_inside_their_document(spark, odd):
    want = {(d, len(t), w): n for d, t in ODD for w, n in Counter(t).items()}
    found = ix.term_frequencies(odd)
    assert "Exchange" not in plan(found) and plan(found).count("sort_array") == 1
    assert {tuple(r)[:3]: r["tf"] for r in found.collect()} == want
    only = spark.createDataFrame([("a'b\\c",), ("b",), ("none",)], "token string")
    few = {k: n for k, n in want.items() if k[2] in ("a'b\\c", "b")}
    assert {tuple(r)[:3]: r["tf"] for r in ix.term_frequencies(odd, only=only).collect()} == few


def test_more_words_than_are_looked_up_in_a_row_are_joined(odd, spark, monkeypatch):
    monkeypatch.setattr(ix, "MOST_WORDS", 1)
    only = spark.createDataFrame([("b",), ("zz",)], "token string")
    assert {(r["doc_id"], r["token"]): r["tf"] for r in ix.term_frequencies(odd, only=only).collect()} == {(1, "b"): 2, (-3, "b"): 1, (-3, "zz"): 1}


def test_own_stems_are_counted_inside_their_document(odd):
    found = ix.term_frequencies(odd, lambda word: None if word == "é" else word[:1])
    assert "Exchange" not in plan(found)
    assert {(r["doc_id"], r["l_d"], r["token"]): r["tf"] for r in found.collect()} == {(1, 4, "b"): 2, (1, 4, "a"): 1, (1, 4, None): 1, (-3, 5, "a"): 3, (-3, 5, "z"): 1, (-3, 5, "b"): 1}


def test_scores_are_added_where_a_document_meets_the_queries(odd, spark, monkeypatch):
    """Only postings are shuffled, by document, and not the many pairs of queries and documents."""
    terms = spark.createDataFrame([(q, w, 1 + q) for q in range(3) for w in ("b", "zz")], "query_id long, token string, tf long")
    scores = rt.score(ix.build_index(odd), terms)
    assert "hashpartitioning(query_id" not in plan(scores) and "hashpartitioning(doc_id" in plan(scores)
    want = {(r["query_id"], r["doc_id"]): r["score"] for r in scores.collect()}
    monkeypatch.setattr(rt, "fits", lambda df: False)
    shuffled = rt.score(ix.build_index(odd, only=terms), terms)
    assert "hashpartitioning(query_id" in plan(shuffled)
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in shuffled.collect()} == pytest.approx(want) and len(want) == 6


def test_large_indexes_are_shuffled_once_when_they_are_saved(odd, monkeypatch):
    small = ix.build_index(odd).postings.collect()
    monkeypatch.setattr(ix, "fits", lambda df: False)
    found = ix.build_index(odd).postings.repartition("token").sortWithinPartitions("token", "doc_id")
    assert plan(found).count("Exchange hashpartitioning(token") == 2 and "ShuffledHashJoin" in plan(found)  # postings and terms
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, small))


@pytest.mark.parametrize("ids", [("long", [5, -7, 0]), ("long", [1 << 40, 3, 1 << 50]), ("string", ["b", "a", "c"])])
def test_vocabulary_is_numbered_in_ranges(spark, ids):
    kind, ids = ids
    docs = [(i, f"{n} x {n} y{n} last".split()) for n, i in enumerate(ids)]
    vocab = build_vocab(spark.createDataFrame(docs, f"doc_id {kind}, tokens array<string>"))
    assert "row_number" not in plan(vocab)
    want = list(dict.fromkeys(t for _, tokens in sorted(docs) for t in tokens))
    assert [tuple(r) for r in vocab.orderBy("token_id").collect()] == [(t, i) for i, t in enumerate(want)]
