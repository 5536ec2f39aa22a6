"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import tokenise
from quillspark.operators import index as ix
from quillspark.operators import retrieve as rt
from quillspark.plans import catalogue

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("tokenize_docs", "doc_freq", "postings_lucene", "bm25_lucene_topk", "bm25_bm25plus_topk", "bm25_stemmed_topk", "conversations_search", "pages_search")


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("quillspark-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    noop(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    found = {name: timed(lambda name=name: noop(catalogue.QUERIES[name](spark, SF_DIR))) for name in HEADLINE}

    index = ix.build_index(catalogue.corpus(spark, SF_DIR))
    index.postings.persist()
    found["index_build_persisted"] = timed(index.postings.count)
    queries = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select(F.col("item_id").alias("query_id"), tokenise(F.col("text")).alias("tokens"))
    n = queries.count()
    search = lambda: noop(rt.top_k(rt.score(index, rt.query_terms(queries)), 10))
    search()
    found["batch_search_persisted"] = timed(search)
    one = lambda i: noop(rt.top_k(rt.score(index, rt.query_terms(queries.where(F.col("query_id") == i))), 10))
    single = sorted(timed(lambda i=i: one(i)) for i in range(3))
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(found.values()), 3),
                "unit": "sec",
                "queries": found,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "batch_qps": round(n / found["batch_search_persisted"], 1),
                "single_query_p50_sec": single[1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
