"""Command line: ``index`` a JSON-lines corpus, ``query`` it with JSON-lines queries."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.scoring import METHODS
from .operators.retrieve import collected
from .retriever import Retriever
from .sources import index_store, jsonl
from .sources.shared import cut, if_small

DOC_IDS = "doc_ids"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    commands = parser.add_subparsers(dest="command")
    index = commands.add_parser("index", help="build an index")
    index.add_argument("--corpus", required=True)
    index.add_argument("--out", required=True)
    index.add_argument("--method", default="lucene", choices=METHODS)
    index.add_argument("--k1", type=float, default=1.5)
    index.add_argument("--b", type=float, default=0.75)
    index.add_argument("--delta", type=float, default=0.5)
    index.add_argument("--text-fields", default="text", help="comma-separated; several are joined by a space")
    query = commands.add_parser("query", help="search an index")
    query.add_argument("--index", required=True)
    query.add_argument("--queries", required=True)
    query.add_argument("--out", required=True)
    query.add_argument("--k", type=int, default=10)
    query.add_argument("--padded", action="store_true", help="always k results, topped up by the first document at score 0")
    return parser


def _index(spark: SparkSession, args: argparse.Namespace) -> None:
    corpus = jsonl.read_corpus(spark, args.corpus, tuple(args.text_fields.split(",")))
    Retriever(args.k1, args.b, args.delta, args.method).index(corpus).save(args.out)
    corpus.select("doc_id", "_id").write.mode("overwrite").parquet(f"{args.out}/{DOC_IDS}")


def _query(spark: SparkSession, args: argparse.Namespace) -> None:
    retriever = Retriever.load(args.index, spark)
    if not jsonl.exists(spark, f"{args.index}/{DOC_IDS}"):
        raise FileNotFoundError(f"{args.index}/{DOC_IDS}")
    names = spark.read.parquet(f"{args.index}/{DOC_IDS}").withColumnRenamed("_id", "name")
    queries = jsonl.read_queries(spark, args.queries)
    hits = if_small(cut(retriever.retrieve(queries, args.k, padded=args.padded), "hits"))
    named = hits.join(names, "doc_id").select("query_id", "rank", F.col("name").alias("doc_id"), "score")
    jsonl.write_results(collected(named, queries).join(queries.select("query_id", "_id"), "query_id"), args.out)


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if args.command is None:
        parser.print_help(sys.stderr)
        return 2
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    try:
        (_index if args.command == "index" else _query)(spark, args)
    except (OSError, ValueError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
