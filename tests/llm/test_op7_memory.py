import pytest

from quillspark.llm import common, quality
from quillspark.llm import near_dup as nd

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_texts_reach_python_in_small_batches_and_the_session_keeps_its_own(spark, monkeypatch):
    seen, whole = [], nd.cut
    monkeypatch.setattr(nd, "cut", lambda df, name="cut": (seen.append(spark.conf.get(BYTES)), whole(df, name))[1])
    before = spark.conf.get(BYTES)
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "another text")], "doc_id long, text string")
    assert nd.near_duplicates(docs).count() == 2
    assert seen and set(seen) == {nd.BATCH} and spark.conf.get(BYTES) == before
    with pytest.raises(ValueError), common.arrow_batches(spark, "1m"):
        raise ValueError
    assert spark.conf.get(BYTES) == before


def test_freed_memory_includes_the_models_of_the_classifier(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "shard=0").mkdir()
    rows = {"model": pa.array([0], pa.int32()), "k": pa.array([1], pa.int32()), "is_left": [False], "hash": [5], "ln_p": pa.array([-1.0], pa.float32())}
    pq.write_table(pa.table(rows), tmp_path / "shard=0" / "a.parquet")
    quality._loaded(str(tmp_path), 0)
    assert quality._loaded.cache_info().currsize == 1
    common.free_memory()
    assert quality._loaded.cache_info().currsize == 0
