"""Ranked retrieval: query terms joined with postings, summed, cut at k per query."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, fits, if_small
from .index import Index, Stemmer, stemmed

DIGITS = 6


def query_terms(tokens: DataFrame, stemmer: Stemmer = None) -> DataFrame:
    """``tokens(query_id, tokens)`` -> ``(query_id, token, tf)``: repeated terms count as often as they stand."""
    counts = tokens.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("tf"))
    return stemmed(counts, stemmer, ["query_id"])


#: Scores that one task adds up.
PAIRS = 1_000_000


def accumulate(postings: DataFrame, terms: DataFrame, key: str = "token", n_docs: int | None = None) -> DataFrame:
    """``(query_id, doc_id, score)``: the sum over the query's terms, repeats included.

    If the queries can be broadcast, postings of their terms go to tasks by document before they meet the queries, each of
    which multiplies them: a document's scores are then added up where they are made."""
    terms = terms.select("query_id", key, F.col("tf").alias("qtf"))
    rows = postings.select(key, "doc_id", "score")
    if fits(terms):
        rows = rows.join(F.broadcast(terms.select(key).distinct()), key, "left_semi")
        rows = rows.repartition("doc_id") if n_docs is None else rows.repartition(_parts(terms, n_docs), "doc_id")
        terms = F.broadcast(terms)
    return rows.join(terms, key).groupBy("query_id", "doc_id").agg(F.sum(F.col("score") * F.col("qtf")).alias("score"))


def _parts(terms: DataFrame, n_docs: int) -> int:
    n_queries = terms.agg(F.count_distinct("query_id")).first()[0]
    return min(MOST_PARTS, max(terms.sparkSession.sparkContext.defaultParallelism, math.ceil(n_docs * n_queries / PAIRS)))


MOST_PARTS = 4_000


def offsets(terms: DataFrame, index: Index) -> DataFrame:
    """``(query_id, offset)``: what every document scores for the query's terms if it has none of them."""
    known = index.terms.select("token", "nonoccurrence").join(if_small(terms), "token")
    return known.groupBy("query_id").agg(F.sum(F.col("tf") * F.coalesce("nonoccurrence", F.lit(0.0))).alias("offset"))


def score(index: Index, terms: DataFrame, *, add_offset: bool = True) -> DataFrame:
    """``(query_id, doc_id, score)`` of documents with at least one of the query's terms; unknown terms drop out."""
    scores = accumulate(index.postings, terms, n_docs=index.n_docs)
    if not (add_offset and index.config.shifted):
        return scores
    found = if_small(cut(offsets(terms, index), "offsets"))
    return scores.join(found, "query_id").select("query_id", "doc_id", (F.col("score") + F.col("offset")).alias("score"))


def add_priors(priors: DataFrame, scores: DataFrame) -> DataFrame:
    """``priors(doc_id, prior)`` plus ``scores(doc_id, score)``, for every document of ``priors``, which must hold floats."""
    if dict(priors.dtypes).get("prior") not in ("float", "double"):
        raise ValueError("priors must be a column of floats")
    return priors.join(scores, "doc_id", "left").select("doc_id", (F.col("prior") + F.coalesce("score", F.lit(0.0))).alias("score"))


def weigh(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores times ``weights(doc_id, weight)``; documents without a weight keep theirs."""
    return scores.join(weights, "doc_id", "left").withColumn("score", F.col("score") * F.coalesce("weight", F.lit(1.0))).drop("weight")


def ordered(rank_by: Column | None = None) -> list[Column]:
    return [(F.col("score") if rank_by is None else rank_by).desc(), F.col("doc_id").asc()]


def top_k(scores: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: the k best of each query, ties to the smaller doc_id.

    With ``digits`` scores are rounded before they are ranked."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*ordered())))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def top_k_global(scores: DataFrame, k: int, *, algorithm: str = "heap", strict: bool = True) -> DataFrame:
    """The k best of ``scores(doc_id, score)``. Both algorithm names give the same plan."""
    if algorithm not in ("heap", "quickselect"):
        raise ValueError(f"unknown algorithm {algorithm!r}")
    if k < 1:
        raise ValueError("k must be at least 1")
    if strict and scores.limit(k).count() < k:
        raise ValueError("k exceeds the number of scores")
    return scores.orderBy(*ordered()).limit(k)


def filled(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int, offset: DataFrame | None = None) -> DataFrame:
    """Tops up queries with fewer than k hits by unmatched documents in the order of doc_id, which score
    the query's offset (0 without one).

    At most k hits are in the way of a query, so its fillers are among the first 2 k documents: those
    few (checked by k, not by the corpus) meet the queries, and no other document does."""
    short = queries.select("query_id").distinct().join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < k)
    first = docs.select("doc_id").distinct().orderBy("doc_id").limit(2 * k)
    first = first.select("doc_id", F.row_number().over(Window.orderBy("doc_id")).alias("_nth"))  # 2 k rows at most
    fillers = short.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.lit(2 * k)))).join(first, "_nth").drop("_nth")
    fillers = fillers.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    fillers = fillers.withColumn("rank", (F.col("n") + nth).cast("long")).where(F.col("rank") <= k)
    if offset is not None:
        fillers = fillers.join(offset, "query_id", "left").withColumn("score", F.round(F.coalesce("offset", F.lit(0.0)), DIGITS))
    else:
        fillers = fillers.withColumn("score", F.lit(0.0))
    return hits.unionByName(fillers.select("query_id", "rank", "doc_id", "score"))


def padded(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The dense form: ranks 1 to k of every query, with document 0 and score 0 where there is no hit."""
    grid = queries.select("query_id").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))))
    return grid.join(hits, ["query_id", "rank"], "left").select("query_id", "rank", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def collected(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query with its hits in rank order (at most k of them): ``(query_id, doc_ids, scores)``."""
    packed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("hits"))
    return queries.select("query_id").join(packed, "query_id", "left").select(
        "query_id",
        F.coalesce(F.transform("hits", lambda h: h["doc_id"]), F.array().cast(f"array<{dict(hits.dtypes)['doc_id']}>")).alias("doc_ids"),
        F.coalesce(F.transform("hits", lambda h: h["score"]), F.array().cast("array<double>")).alias("scores"),
    )


def check_ids(query_ids: DataFrame, n_vocab: int) -> DataFrame:
    """``query_ids(query_id, token_id)``, after checking that every id is in the vocabulary."""
    if not query_ids.where((F.col("token_id") < 0) | (F.col("token_id") >= n_vocab)).isEmpty():
        raise IndexError(f"token ids must lie in [0, {n_vocab})")
    return query_ids


def to_int32(column: Column) -> Column:
    """A cast that raises where the value does not fit (ANSI mode)."""
    return column.cast("int")


def score_matrix(matrix: DataFrame, query_ids: DataFrame, n_vocab: int, n_docs: int | None = None) -> DataFrame:
    """``(query_id, doc_id, score)`` from ``matrix(token_id, doc_id, score)`` and id queries; float32 matrices only.
    With ``n_docs``, the number of documents, tasks are made for so many."""
    if dict(matrix.dtypes)["score"] != "float":
        raise ValueError("the score matrix must hold 32-bit floats")
    terms = check_ids(query_ids, n_vocab).groupBy("query_id", "token_id").agg(F.count("*").alias("tf"))
    return accumulate(matrix, terms, "token_id", n_docs).withColumn("score", F.col("score").cast("float"))
