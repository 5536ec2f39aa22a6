import __spark_entry__ as entry


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert "bm25_lucene_topk" in queries
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
