"""Vocabulary: tokens to dense ids in the order of first occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, fits, if_small, with_ordinals


def exploded(tokens: DataFrame) -> DataFrame:
    """``tokens(doc_id, tokens)`` -> ``(doc_id, pos, token)``."""
    return tokens.select("doc_id", F.posexplode("tokens").alias("pos", "token"))


def build_vocab(tokens: DataFrame) -> DataFrame:
    """``(token, token_id)``: ids from 0 by the smallest (doc_id, pos) of each token.

    The grouping is partial per task, in one number where doc_ids are whole numbers of 32 bits (a smallest struct would sort
    all tokens). Distinct tokens are sorted by ranges and cut; an id is the place in its range and the ranges' sizes before."""
    rows, at = exploded(tokens), F.struct("doc_id", "pos")
    if _narrow(tokens):
        at = F.shiftleft(F.col("doc_id").cast("long"), 31) + F.col("pos")
    first = rows.groupBy("token").agg(F.min(at).alias("first")).orderBy("first").withColumn("_at", F.monotonically_increasing_id())
    placed = cut(first.select("token", "_at", F.spark_partition_id().alias("_range")), "vocab")
    return with_ordinals(placed, ["_range"], "_at", "token_id").select("token", F.col("token_id").cast("int").alias("token_id"))


def _narrow(tokens: DataFrame) -> bool:
    if dict(tokens.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        return False
    ends = tokens.agg(F.min("doc_id"), F.max("doc_id")).first()
    return ends[0] is None or (ends[0] >= -(1 << 31) and ends[1] < 1 << 31 and tokens.where("doc_id IS NULL").isEmpty())


def encode(tokens: DataFrame, vocab: DataFrame, unknown: int = -1) -> DataFrame:
    """``(doc_id, pos, token, token_id)`` with ``unknown`` for tokens that the vocabulary lacks. Of a vocabulary only the
    tokens' own words are joined, if those are few."""
    words = cut(exploded(tokens).select("token").distinct(), "words")
    if fits(words):
        vocab = if_small(cut(vocab.join(F.broadcast(words), "token", "left_semi"), "known"))
    return exploded(tokens).join(vocab, "token", "left").withColumn("token_id", F.coalesce("token_id", F.lit(unknown)).cast("int"))


def id_to_token(vocab: DataFrame, token_id: int) -> str:
    row = vocab.where(F.col("token_id") == token_id).select("token").first()
    if row is None:
        raise IndexError(f"no token with id {token_id}")
    return row["token"]
