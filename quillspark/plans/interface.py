"""Registered queries over the interface: files, stores, codecs, ids, stemmers of one's own, and what is refused."""

from __future__ import annotations

from array import array

from pyspark.sql import functions as F

from .. import cli
from ..functions.text import resolve_stopwords
from ..operators import index as ix
from ..operators import retrieve as rt
from ..operators.vocab import build_vocab, encode, id_to_token
from ..retriever import Retriever
from ..sources import binary, index_store, jsonl
from ..sources.shared import cut, if_small, shared_path
from . import oracles as sql
from .catalogue import VOCAB, corpus, register, table


def lines_of(spark, sf_dir: str, name: str, id_col: str) -> str:
    """A table as a folder of JSON lines ``{"_id", "title", "text"}``, in the order of ids by file name and line."""
    path = shared_path(spark, name)
    rows = table(spark, sf_dir, name).select(F.col(id_col).cast("string").alias("_id"), F.coalesce("text", F.lit("")).alias("text"), F.col(id_col).alias("_n"))
    rows.repartitionByRange("_n").sortWithinPartitions("_n").select("_id", F.concat(F.lit("t"), "_id").alias("title"), "text").write.json(path)
    return path


@register("jsonl_records", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, doc_id::VARCHAR AS _id, length(coalesce(text, ''))::BIGINT AS n FROM documents")
def jsonl_records(spark, sf_dir):
    found = jsonl.read_corpus(spark, lines_of(spark, sf_dir, "documents", "doc_id"))
    return found.select(F.col("doc_id").alias("ordinal"), "_id", F.length("text").cast("long").alias("n"))


@register(
    "jsonl_fields_and_heads",
    "SELECT row_number() OVER (ORDER BY item_id) - 1 AS ordinal, item_id::VARCHAR AS _id, trim('t' || item_id || ' ' || text, ' ' || chr(10)) AS text FROM benchmark QUALIFY ordinal < 7",
)
def jsonl_fields_and_heads(spark, sf_dir):
    """A collection's texts are its titles and texts; only its first seven are taken, which is what heads are for."""
    folder = lines_of(spark, sf_dir, "benchmark", "item_id")
    found = jsonl.read_records(spark, folder, text_fields=("title", "text"))
    return found.where(F.col("doc_id") < 7).select(F.col("doc_id").alias("ordinal"), "_id", "text")


@register("cli_index_and_query", f"{sql.hits('bm25+')} SELECT query_id::VARCHAR AS query, rank, score FROM ranked WHERE rank <= 10")
def cli_index_and_query(spark, sf_dir):
    """Both commands over files; scores are given by rank, as equal scores may come in either order."""
    docs, queries = lines_of(spark, sf_dir, "documents", "doc_id"), lines_of(spark, sf_dir, "benchmark", "item_id")
    index, out = shared_path(spark, "cli-index"), shared_path(spark, "cli-results")
    codes = [cli.main(["index", "--corpus", docs, "--out", index, "--method", "bm25+"]), cli.main(["query", "--index", index, "--queries", queries, "--out", out, "--k", "10"])]
    if any(codes):
        raise RuntimeError(f"exit codes {codes}")
    found = spark.read.schema("_id string, doc_ids array<string>, scores array<double>").json(out)
    return found.select(F.col("_id").alias("query"), F.posexplode("scores").alias("rank", "score")).select("query", (F.col("rank") + 1).cast("long").alias("rank"), F.round("score", 6).alias("score"))


@register("retriever_saved_and_loaded", f"{sql.hits('bm25l')} SELECT query_id, rank, score FROM ranked WHERE rank <= 5")
def retriever_saved_and_loaded(spark, sf_dir):
    path = shared_path(spark, "retriever")
    Retriever(method="bm25l").index(table(spark, sf_dir, "documents")).save(path)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = Retriever.load(path, spark).retrieve(items, 5)
    return hits.select("query_id", "rank", F.round("score", 6).alias("score"))


@register("absent_terms", f"WITH {sql.index('lucene')}, wanted AS (SELECT DISTINCT unnest({sql.tokens('text')}) AS token FROM benchmark UNION SELECT 'zzqx') SELECT token, coalesce(df, 0)::BIGINT AS df, round(coalesce(idf, 0.0), 6) AS idf FROM wanted LEFT JOIN terms USING (token)")
def absent_terms(spark, sf_dir):
    """Every term of the items and one that no document has, which gets df and idf 0."""
    items = ix.tokens_of(table(spark, sf_dir, "benchmark"), id_col="item_id").select(F.explode("tokens").alias("token")).unionByName(spark.range(1).select(F.lit("zzqx").alias("token")))
    terms = ix.build_index(corpus(spark, sf_dir), only=items).terms
    return ix.with_absent(terms, items).select("token", "df", F.round("idf", 6).alias("idf"))


@register("empty_corpus_store", "SELECT 0::BIGINT AS n_docs, 0.0::DOUBLE AS l_avg, 0::BIGINT AS n_postings, 0::BIGINT AS n_hits")
def empty_corpus_store(spark, sf_dir):
    path = shared_path(spark, "empty")
    index_store.save_index(ix.build_index(corpus(spark, sf_dir).where("false"), ix.Config(method="bm25+")), path)
    loaded = index_store.load_index(spark, path)
    items = ix.tokens_of(table(spark, sf_dir, "benchmark"), id_col="item_id").withColumnRenamed("doc_id", "query_id")
    hits = rt.score(loaded, rt.query_terms(items)).count()
    return spark.createDataFrame([(loaded.n_docs, float(loaded.l_avg), loaded.postings.count(), hits)], "n_docs long, l_avg double, n_postings long, n_hits long")


@register("ids_and_tokens", f"WITH corpus AS (SELECT item_id AS doc_id, {sql.tokens('text')} AS tokens FROM benchmark), {VOCAB} SELECT token_id, token FROM vocab")
def ids_and_tokens(spark, sf_dir):
    """The items' vocabulary through the binary codec, and each id back to its token."""
    vocab = build_vocab(ix.tokens_of(table(spark, sf_dir, "benchmark"), id_col="item_id"))
    tokens = [r["token"] for r in vocab.orderBy("token_id").collect()]  # of the items alone
    again = binary.read_vocab(binary.write_vocab(tokens))
    ids = binary.read_vector(binary.write_vector(range(len(again)), "i"), "i")
    if tokens and id_to_token(vocab, 0) != again[0]:
        raise RuntimeError("the first id has another token")
    return spark.createDataFrame(list(zip(ids, again)), "token_id int, token string")


@register(
    "id_queries_on_a_matrix",
    f"""WITH {sql.corpus()}, {VOCAB}, {sql.raw_terms()}, flat AS (SELECT item_id, unnest({sql.tokens('text')}) AS token FROM benchmark),
    q AS (SELECT item_id AS query_id, token, count(*) AS qtf FROM flat GROUP BY ALL)
    SELECT query_id, doc_id, sum(tf * qtf)::FLOAT AS score FROM q JOIN tf USING (token) GROUP BY ALL""",
)
def id_queries_on_a_matrix(spark, sf_dir):
    """Queries of token ids on a 32-bit matrix of term frequencies; unknown tokens have no id and drop out. The matrix has
    the columns of the queries' tokens, the only ones that are asked for."""
    tokens = corpus(spark, sf_dir)
    vocab = build_vocab(tokens)
    items = ix.tokens_of(table(spark, sf_dir, "benchmark"), id_col="item_id")
    known = cut(encode(items, vocab).where("token_id >= 0"), "ids")
    ids = known.select(F.col("doc_id").alias("query_id"), rt.to_int32(F.col("token_id")).alias("token_id"))
    columns = cut(known.select("token", "token_id").distinct(), "columns")
    matrix = ix.term_frequencies(tokens, only=columns).join(if_small(columns), "token").select("token_id", "doc_id", F.col("tf").cast("float").alias("score"))
    return rt.score_matrix(matrix, ids, vocab.count(), tokens.count())


@register("own_stemmer", f"WITH {sql.corpus()}, {sql.raw_terms()} SELECT doc_id, left(token, 4) AS token, sum(tf)::BIGINT AS tf FROM tf GROUP BY ALL")
def own_stemmer(spark, sf_dir):
    return ix.term_frequencies(corpus(spark, sf_dir), lambda word: word[:4]).select("doc_id", "token", "tf")


REFUSED = {
    "stopword list": "ValueError",
    "method": "ValueError",
    "k of 0": "ValueError",
    "algorithm": "ValueError",
    "k beyond the scores": "ValueError",
    "token id": "IndexError",
    "64-bit matrix": "ValueError",
    "whole-number priors": "ValueError",
    "cut-off vector": "ValueError",
    "cut-off vocabulary": "ValueError",
    "64-bit data": "ValueError",
    "empty corpus": "ValueError",
    "nothing indexed": "RuntimeError",
    "missing file": "FileNotFoundError",
    "missing index": "FileNotFoundError",
    "no object": "ValueError",
    "no text": "ValueError",
    "command on a missing file": "2",
    "no command": "2",
    "value beyond 32 bits": "refused",
}


@register("refused", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in REFUSED.items()) + ") AS t(what, outcome)")
def refused(spark, sf_dir):
    """What the interface refuses, and how."""
    scores = spark.createDataFrame([(1, 1.0)], "doc_id long, score double")
    matrix = spark.createDataFrame([(0, 1, 1.0)], "token_id int, doc_id long, score double")
    ids = spark.createDataFrame([(1, 5)], "query_id long, token_id int")
    lines = {}
    for name, line in (("no object", "[1]\n"), ("no text", '{"_id": "a"}\n')):
        lines[name] = shared_path(spark, "lines")
        index_store.write_text(spark, lines[name], line)
    none = shared_path(spark, "none")

    def beyond() -> None:
        try:
            spark.createDataFrame([(1 << 40,)], "x long").select(rt.to_int32(F.col("x"))).collect()
        except Exception:  # noqa: BLE001 - the session's arithmetic error
            return "refused"

    tries = {
        "stopword list": lambda: resolve_stopwords("xx"),
        "method": lambda: ix.Config(method="bm26"),
        "k of 0": lambda: rt.top_k(scores, 0),
        "algorithm": lambda: rt.top_k_global(scores, 1, algorithm="bubble"),
        "k beyond the scores": lambda: rt.top_k_global(scores, 2),
        "token id": lambda: rt.check_ids(ids, 5),
        "64-bit matrix": lambda: rt.score_matrix(matrix, ids, 9),
        "whole-number priors": lambda: rt.add_priors(spark.createDataFrame([(1, 1)], "doc_id long, prior long"), scores),
        "cut-off vector": lambda: binary.read_vector(b"12345", "f"),
        "cut-off vocabulary": lambda: binary.read_vocab(b"\2\0\0\0\1\0\0\0a"),
        "64-bit data": lambda: binary.from_csc(spark, array("d", [1.0]), [0], [0, 1]),
        "empty corpus": lambda: Retriever().index([]),
        "nothing indexed": lambda: Retriever().retrieve(["a"]),
        "missing file": lambda: jsonl.read_corpus(spark, none),
        "missing index": lambda: Retriever.load(none, spark),
        "no object": lambda: jsonl.read_corpus(spark, lines["no object"]),
        "no text": lambda: jsonl.read_corpus(spark, lines["no text"]),
        "command on a missing file": lambda: cli.main(["index", "--corpus", none, "--out", none]),
        "no command": lambda: cli.main([]),
        "value beyond 32 bits": beyond,
    }
    found = []
    for what, act in tries.items():
        try:
            outcome = str(act())
        except Exception as error:  # noqa: BLE001 - its name is the result
            outcome = type(error).__name__
        found.append((what, outcome))
    return spark.createDataFrame(found, "what string, outcome string")
