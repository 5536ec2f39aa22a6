"""Saving and loading an index: Parquet tables and one meta file, staged and renamed into place."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ENGLISH_STOPWORDS
from ..operators.index import Config, Index
from .jsonl import exists

VERSION = 1
TABLES = ("postings", "terms", "docs")


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, target = _hadoop(spark, path)
    stream = system.create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def stopwords_to_json(stopwords) -> str | list[str]:
    """None: "none"; the built-in list: "default"; a name stays; other words: a sorted list."""
    if stopwords is None:
        return "none"
    if stopwords == ENGLISH_STOPWORDS:
        return "default"
    return stopwords if isinstance(stopwords, str) else sorted(stopwords)


def stopwords_from_json(value):
    if value == "none":
        return None
    if value == "default":
        return ENGLISH_STOPWORDS
    return value if isinstance(value, str) else frozenset(value)


def stemmer_name(stemmer) -> str:
    return "none" if stemmer is None else stemmer if stemmer == "porter" else "unknown"


def save_index(index: Index, path: str, **extras) -> None:
    """A term's postings are in one file, sorted by term, so that a query's terms prune pages. They are parted as the index
    parts them if it joined its terms by shuffle, and so are shuffled once. The meta file is written last; only
    then is the staging folder renamed over an older index."""
    spark = index.postings.sparkSession
    staging = f"{path.rstrip('/')}.tmp"
    system, target = _hadoop(spark, path)
    _, temporary = _hadoop(spark, staging)
    system.delete(temporary, True)
    index.postings.repartition("token").sortWithinPartitions("token", "doc_id").write.parquet(f"{staging}/postings")
    terms = index.terms if index.config.shifted else index.terms.withColumn("nonoccurrence", F.lit(None).cast("double"))
    terms.write.parquet(f"{staging}/terms")
    index.docs.write.parquet(f"{staging}/docs")
    sizes = {f"rows_{name}": spark.read.parquet(f"{staging}/{name}").count() for name in TABLES}
    write_text(spark, f"{staging}/meta.json", json.dumps({"version": VERSION} | index.meta() | sizes | extras))
    system.delete(target, True)
    if not system.rename(temporary, target):
        raise OSError(f"cannot rename {staging} to {path}")


def load_index(spark: SparkSession, path: str) -> Index:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    meta = json.loads(read_text(spark, f"{path}/meta.json"))
    version = meta.get("version")
    if type(version) is not int or version > VERSION or version < 1:
        raise ValueError(f"{path}: version {version!r} cannot be read; known up to {VERSION}")
    tables: dict[str, DataFrame] = {}
    for name in TABLES:
        if not exists(spark, f"{path}/{name}"):
            raise FileNotFoundError(f"{path}/{name}")
        tables[name] = spark.read.parquet(f"{path}/{name}")
        if tables[name].count() != meta[f"rows_{name}"]:
            raise ValueError(f"{path}/{name}: its rows do not agree with the meta file")
    if meta["n_docs"] != meta["rows_docs"]:
        raise ValueError(f"{path}: documents do not agree with the meta file")
    config = Config(**{k: meta[k] for k in ("k1", "b", "delta", "method", "idf_method")})
    if not config.shifted and not tables["terms"].where("nonoccurrence is not null").isEmpty():
        raise ValueError(f"{path}: {config.method} has no scores for absent terms, but the index holds some")
    return Index(config, tables["postings"], tables["terms"], tables["docs"], meta["n_docs"], meta["l_avg"], meta)


def save_vocab(vocab: DataFrame, path: str) -> None:
    """``{"version": 1, "tokens": [...]}`` in the order of ids: an export for small vocabularies, made on the driver."""
    tokens = [r["token"] for r in vocab.orderBy("token_id").select("token").collect()]
    write_text(vocab.sparkSession, path, json.dumps({"version": 1, "tokens": tokens}, ensure_ascii=False))


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    tokens = json.loads(read_text(spark, path))["tokens"]
    return spark.createDataFrame(list(zip(tokens, range(len(tokens)))), "token string, token_id int")
