import random

import duckdb
import pytest

from quillspark.llm import mixing as mx


def build(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as target", "3 as shard", "'c' as code", "4 as _row")


def brute_targets(sizes, weights=(3, 1, 2)):
    """Round by round: share by weight among those that are not full."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total, spill = sum(w[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * w[s] / total
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                spill += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.discard(s)
        left = spill
    return target


def brute_seats(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_targets_taken_and_limits(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "é", "b", "", None]), " ".join(["w"] * rng.randint(0, 900))) for i in range(400)]
    rows += [(1000, "tiny", "one two"), (1001, "none", None), (1002, "a", " x\ty\x0bz "), (None, "b", "q " * 50), (7, "b", "dup " * 40), (7, "b", "dup " * 40), (2000, "a", "x " * 60000)]
    docs = build(spark, rows)
    out = mx.mix(docs, shard_words=20000).collect()
    size = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w])
    assert sorted(r["size"] for r in out) == sorted(size(t) for _, _, t in rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 32 * (2 + sizes[s] // 20000)
    again = mx.mix(docs.repartition(7), shard_words=20000).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_seats_are_those_of_the_highest_quotients(spark):
    rng = random.Random(2)
    for m, seats in ((1, 5), (4, 0), (5, 17), (9, 3), (12, 200)):
        weights = [rng.choice([0.0, 1.0, 1.0, rng.random() * 50]) for _ in range(m)]
        weights[0] = 3.0
        rows = spark.createDataFrame([(i, w, seats) for i, w in enumerate(weights)], "name int, share double, seats long")
        got = {r["name"]: r["quota"] for r in mx.sainte_lague(rows, [], "name", "share", "seats").collect()}
        assert [got[i] for i in range(m)] == brute_seats(weights, seats)


def test_same_as_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), None if i % 9 == 0 else "w " * rng.randint(0, 300)) for i in range(60)]
    build(spark, rows).drop("size", "target").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.sql(mx.ORACLE).select("doc_id, size, source_size, target, taken").fetchall())
    assert sorted(tuple(r) for r in mx.op10_source_mixing(spark, str(tmp_path)).collect()) == want


def test_empty_and_all_zero(spark):
    docs = build(spark, [(1, "a", None), (2, "b", "  ")])
    assert [(r["target"], r["taken"]) for r in mx.mix(docs).collect()] == [(0.0, 0)] * 2
    assert mx.mix(docs.where("false")).count() == 0
    assert mx.mixed(docs).count() == 0
