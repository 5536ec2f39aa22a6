import json

import pytest

from quillspark.cli import main
from quillspark.retriever import Retriever
from quillspark.sources import index_store, jsonl
from quillspark.streaming.search import search_stream

TEXTS = ["a cat is small", "a dog is big", "fish swim in the sea", "the lazy dog sleeps", "the quick brown fox jumps over the lazy dog"]


def hits(result):
    return [(r["query_id"], r["doc_id"], r["score"]) for r in result.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("method", ["lucene", "atire", "bm25l", "bm25+"])
def test_fish_is_found(spark, method):
    assert hits(Retriever(method=method).index(TEXTS).retrieve(["fish swim"], 2))[0][1] == 2


def test_options(spark):
    assert hits(Retriever(stopwords={"fish"}).index(TEXTS).retrieve(["fish"])) == []
    assert len(hits(Retriever(stopwords=None).index(TEXTS).retrieve(["the"]))) == 3
    assert hits(Retriever().index(TEXTS).retrieve(["zebra aardvark"])) == []
    one_shot = Retriever(stopwords=(w for w in ["fish"])).index(TEXTS)
    assert hits(one_shot.retrieve(["fish"])) == hits(one_shot.retrieve(["fish"])) == []


def test_stemming(spark):
    texts = ["the cat runs fast", "the dog is running quickly", "the bird flew yesterday"]
    assert {d for _, d, _ in hits(Retriever(stemmer="porter").index(texts).retrieve(["running"], 2))} == {0, 1}
    assert [d for _, d, _ in hits(Retriever().index(texts).retrieve(["running"], 2))] == [1]


def test_fill_scores_the_offset(spark):
    got = hits(Retriever(method="bm25+").index(TEXTS).retrieve(["fish"], 5, fill=True))
    assert [d for _, d, _ in got] == [2, 0, 1, 3, 4] and len({round(s, 6) for _, _, s in got[1:]}) == 1 and got[1][2] > 0
    assert [s for _, _, s in hits(Retriever().index(TEXTS).retrieve(["fish"], 3, fill=True))][1:] == [0.0, 0.0]


def test_reindexing_replaces_and_errors(spark):
    r = Retriever()
    with pytest.raises(RuntimeError):
        r.retrieve(["x"])
    r.index(TEXTS).index(["one two", "three"])
    assert r.indexed.n_docs == 2
    with pytest.raises(ValueError):
        r.index([])
    assert r.indexed.n_docs == 2
    with pytest.raises(ValueError):
        r.retrieve(["x"], 0)
    with pytest.raises(ValueError):
        Retriever(method="nope")


@pytest.mark.parametrize("options", [{}, {"method": "bm25l", "k1": 3.5, "b": 0.1}, {"stemmer": "porter", "stopwords": None, "idf_method": "bm25+"}])
def test_save_and_load(spark, tmp_path, options):
    before = Retriever(**options).index(TEXTS)
    before.save(f"{tmp_path}/index")
    before.save(f"{tmp_path}/index")
    after = Retriever.load(f"{tmp_path}/index")
    assert after.config == before.config and after.stopwords == before.stopwords and after.stemmer == before.stemmer
    assert hits(after.retrieve(["lazy dogs", "fish"])) == hits(before.retrieve(["lazy dogs", "fish"]))


def test_load_refuses(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Retriever.load(f"{tmp_path}/none")
    Retriever().index(TEXTS).save(f"{tmp_path}/index")
    meta = tmp_path / "index" / "meta.json"
    held = json.loads(meta.read_text())
    (tmp_path / "index" / ".meta.json.crc").unlink(missing_ok=True)
    for change in ({"version": 2}, {"version": "1"}, {"rows_postings": 1}, {"n_docs": 99}):
        meta.write_text(json.dumps(held | change))
        with pytest.raises(ValueError):
            Retriever.load(f"{tmp_path}/index")


def test_vocab_file(spark, tmp_path):
    vocab = spark.createDataFrame([("b", 1), ("é", 0)], "token string, token_id int")
    index_store.save_vocab(vocab, f"{tmp_path}/vocab.json")
    assert [tuple(r) for r in index_store.load_vocab(spark, f"{tmp_path}/vocab.json").orderBy("token_id").collect()] == [("é", 0), ("b", 1)]
    with pytest.raises(FileNotFoundError):
        index_store.load_vocab(spark, f"{tmp_path}/none.json")


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_cli(spark, tmp_path, capsys):
    corpus = lines(tmp_path / "corpus.jsonl", [{"_id": f"doc{i + 1}", "text": t, "more": 1} for i, t in enumerate(TEXTS)] + [""])
    queries = lines(tmp_path / "queries.jsonl", [{"_id": "q1", "text": "lazy dog"}, {"_id": "q2", "text": "zebra"}])
    assert main(["index", "--corpus", corpus, "--out", f"{tmp_path}/ix", "--method", "bm25l", "--k1", "2"]) == 0
    assert main(["query", "--index", f"{tmp_path}/ix", "--queries", queries, "--out", f"{tmp_path}/out", "--k", "2"]) == 0
    found = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert [f["_id"] for f in found] == ["q1", "q2"]
    assert set(found[0]["doc_ids"]) == {"doc4", "doc5"} and found[1]["doc_ids"] == []
    assert main([]) == 2
    for bad in ([{"_id": "x"}], ["{oops"], []):
        assert main(["index", "--corpus", lines(tmp_path / "bad.jsonl", bad), "--out", f"{tmp_path}/no"]) == 2
    assert main(["index", "--corpus", f"{tmp_path}/none.jsonl", "--out", f"{tmp_path}/no"]) == 2
    assert main(["query", "--index", f"{tmp_path}/none", "--queries", queries, "--out", f"{tmp_path}/no"]) == 2
    with pytest.raises(ValueError, match="bad.jsonl:2"):
        jsonl.read_corpus(spark, lines(tmp_path / "bad.jsonl", [{"_id": "a", "text": "b"}, "{oops"]))


def test_collection(spark, tmp_path):
    lines(tmp_path / "corpus.jsonl", [{"_id": "a", "title": "T", "text": " body "}, {"_id": "b", "text": "only"}, {"_id": "c", "text": "x"}])
    lines(tmp_path / "queries.jsonl", [{"_id": "q", "text": "body"}])
    corpus, queries = jsonl.read_collection(spark, str(tmp_path), corpus_head=2)
    assert [tuple(r) for r in corpus.orderBy("doc_id").collect()] == [(0, "a", "T  body"), (1, "b", "only")] and queries.count() == 1


def test_stream_of_queries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "1.json", [{"query_id": 5, "text": "fish"}])
    stream = spark.readStream.schema("query_id long, text string").json(f"{tmp_path}/in")
    found = []
    run = search_stream(stream, Retriever().index(TEXTS), lambda df, n: found.extend((n, r["query_id"], r["doc_id"]) for r in df.collect()), once=True, checkpoint=f"{tmp_path}/state")
    run.awaitTermination(120)
    assert found == [(0, 5, 2)]
