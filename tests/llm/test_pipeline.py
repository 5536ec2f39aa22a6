"""The stages against what each may and must do, on a small corpus with known cases."""

import random
import re

import corpus_pipeline

RNG = random.Random(11)
VOCAB = ["".join(RNG.choice(["ka", "lo", "mi", "ren", "sto", "vu"]) for _ in range(RNG.randint(1, 4))) for _ in range(2000)]


def sentence(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n)).capitalize() + "."


def test_stages_and_run(spark, tmp_path):
    item = sentence(30)
    texts = {i: sentence(RNG.randint(20, 60)) for i in range(250)}
    texts |= {300 + i: " ".join("#%&" + "Q" * 6 for _ in range(40)) for i in range(5)}
    texts |= {400: texts[3], 401: texts[3].upper(), 402: sentence(10) + " " + item + " " + sentence(10), 403: sentence(25) + " password=hunter22", 404: "", 405: None}
    rows = [(i, t, "xx", None if i % 9 == 0 else f"src{i % 4}", len(t or ""), "kept") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert [name.split()[0] for name, _ in corpus_pipeline.STAGES] == ["quality", "MinHash", "benchmark", "secret", "mixing"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "key"]
    got = {r["doc_id"]: r for r in out.collect()}
    # junk, copies, leaks and texts without words go; the rest stays as far as the mix takes words of it
    gone = set(range(300, 305)) | {400, 401, 402, 404, 405}
    assert not gone & set(got)
    assert got[403]["text"].endswith("[SECRET]") and got[403]["n_chars"] == len(got[403]["text"])
    assert all(r["text"] == texts[i] for i, r in got.items() if i != 403)
    sizes = {}
    for i, t in texts.items():
        if i not in gone:
            size = len(re.findall(r"\S+", t if i != 403 else got[403]["text"]))
            source = None if i % 9 == 0 else f"src{i % 4}"
            sizes[source] = sizes.get(source, 0) + size
    for r in got.values():
        assert 0 < r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
    for source, total in sizes.items():
        mine = [r for r in got.values() if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 64
