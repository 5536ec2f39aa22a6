"""JSON lines: corpus and query records ``{"_id", "text"}``, and result records."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, with_ordinals

CORRUPT = "_corrupt_record"
PLACE = ("_file", "_start", "_at")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def _scan(spark: SparkSession, path: str, fields: Iterable[str]) -> DataFrame:
    """One row per non-blank line; lines are in file order by ``PLACE`` (Spark does not read files in the order of their
    names, but a split of a file lies in one task). ``_at`` has no gaps in a split, ``_line`` counts blank lines too."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields] + [T.StructField(CORRUPT, T.StringType())])
    lines = _lines(spark, path).where(F.trim("value") != "").withColumn("_at", F.monotonically_increasing_id())
    parsed = lines.withColumn("_row", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    return parsed.select(*PLACE, "_line", "_row.*")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.text(path)
    return read.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))


def _checked(rows: DataFrame, path: str, required: Iterable[str]) -> DataFrame:
    bad = rows.where(F.col(CORRUPT).isNotNull()).orderBy(*PLACE).select(*PLACE, "_line", CORRUPT).first()
    if bad is not None:
        try:
            json.loads(bad[CORRUPT])
        except ValueError as error:
            raise ValueError(f"{path}:{_line_number(rows.sparkSession, path, bad)}: {error}") from None
        raise ValueError(f"{path}:{_line_number(rows.sparkSession, path, bad)}: not an object of strings")
    for field in required:
        if not rows.where(F.col(field).isNull()).isEmpty():
            raise ValueError(f"{path}: a record lacks {field!r}")
    return rows


def _line_number(spark: SparkSession, path: str, bad: Row) -> int:
    place, at = ("_file", "_start", "_line"), ("string", "long", "long")
    return _lines(spark, path).where(F.struct(*place) <= F.struct(*(F.lit(bad[c]).cast(t).alias(c) for c, t in zip(place, at)))).count()


def read_records(spark: SparkSession, path: str, *, text_fields: tuple[str, ...] = ("text",), ordinal: str = "doc_id") -> DataFrame:
    """``(ordinal, _id, text)``; several ``text_fields`` are joined by a space, missing ones left out. The parsed lines are
    cut, and each line's number is its place in its split and the sizes of the splits before: no text is shuffled."""
    fields = ["_id", *dict.fromkeys(text_fields)]
    rows = _checked(cut(_scan(spark, path, fields), "records"), path, ["_id", "text"] if text_fields == ("text",) else ["_id"])
    text = F.col("text") if text_fields == ("text",) else strip(F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in text_fields)))
    return with_ordinals(rows, ["_file", "_start"], "_at", ordinal).select(ordinal, "_id", text.alias("text"))


def read_corpus(spark: SparkSession, path: str, text_fields: tuple[str, ...] = ("text",)) -> DataFrame:
    return read_records(spark, path, text_fields=text_fields)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, ordinal="query_id")


def read_collection(spark: SparkSession, folder: str, *, corpus_head: int | None = None, queries_head: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A retrieval test collection: ``corpus.jsonl`` with titles, and ``queries.jsonl``; optionally only the first of each."""
    corpus = read_records(spark, f"{folder}/corpus.jsonl", text_fields=("title", "text"))
    queries = read_queries(spark, f"{folder}/queries.jsonl")
    return (corpus if corpus_head is None else corpus.where(F.col("doc_id") < corpus_head)), (queries if queries_head is None else queries.where(F.col("query_id") < queries_head))


def in_memory(spark: SparkSession, texts: Iterable[str], ordinal: str = "doc_id") -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"{ordinal} long, text string")


def write_results(results: DataFrame, path: str) -> None:
    """``results(query_id, _id, doc_ids, scores)`` as JSON lines in query order, in one folder of files."""
    results.sort("query_id").select("_id", "doc_ids", "scores").write.mode("overwrite").json(path)
