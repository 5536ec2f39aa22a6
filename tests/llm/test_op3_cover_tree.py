import numpy as np
import pytest

from quillspark.llm import common
from quillspark.llm import cover_tree as ct


def brute(vectors, threshold=0.9):
    ok = {i: np.array(v, dtype=float) for i, v in vectors if v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(np.array(v, dtype=float))}
    links = {i: set() for i, _ in vectors}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= threshold:
                links[a].add(b)
    lowest = {i: i for i in links}
    while True:
        new = {i: min([lowest[i], *(lowest[j] for j in links[i])]) for i in links}
        if new == lowest:
            return {i: (len(links[i]), lowest[i], lowest[i] == i) for i in links}
        lowest = new


def got(spark, vectors, **options):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "'x' as rep", "1 as copies")
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ct.near_vectors(df, **options).collect()}


def clustered(seed, n, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    points = centres[rng.integers(6, size=n)] + rng.normal(scale=rng.choice([0.05, 0.3, 1.0], size=(n, 1)), size=(n, dims))
    return [(int(i), [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]


@pytest.mark.parametrize("block_rows", [6000, 40])
def test_against_all_pairs(spark, block_rows):
    vectors = clustered(1, 300)
    vectors += [(300 + i, vectors[0][1]) for i in range(5)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [float("inf")] + [1.0] * 7), (404, [None] + [1.0] * 7), (405, []), (406, [1.0, 2.0]), (407, [2.0, 4.0])]
    assert got(spark, vectors, block_rows=block_rows) == brute(vectors)


def test_empty_and_null_ids(spark):
    assert got(spark, []) == {}
    assert got(spark, [(None, [1.0, 0.0]), (1, [1.0, 0.0])]) == {None: (0, None, True), 1: (0, 1, True)}


def test_tree_bounds_and_traversal():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 6))
    raw = np.repeat(centres, 150, axis=0) + rng.normal(scale=0.1, size=(3000, 6))
    unit = raw / np.linalg.norm(raw, axis=1)[:, None]
    tree = ct.build(unit, np.arange(3000))
    assert tree.children
    stack = [tree]
    while stack:
        node = stack.pop()
        assert np.sqrt(np.maximum(2 - 2 * unit[node.rows] @ unit[node.centre], 0)).max() <= node.radius + 1e-7  # a vector on its own has radius 0
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            assert all(c.radius <= node.radius / 2 + 1e-6 for c in node.children)
        stack += node.children
    pairs = {(min(a, b), max(a, b)) for p, q in ct.dual_pairs(raw, np.arange(3000), None, 0.95) for a, b in zip(p.tolist(), q.tolist())}
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    assert pairs == set(zip(i.tolist(), j.tolist()))


def test_pruning_on_clustered_and_on_spread_vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    clustered = np.repeat(centres, 50, axis=0) + rng.normal(scale=0.02, size=(2000, 64))
    seen = {}
    pairs = sum(len(p) for p, _ in ct.dual_pairs(clustered, np.arange(2000), None, 0.99, seen))
    assert pairs == 40 * 50 * 49 // 2 and seen["tested"] < 0.1 * 2000**2 and seen["pruned"] > 0.2 * seen["tested"]
    spread = rng.normal(size=(2000, 64))
    spread[1000:1010] = spread[:10] + rng.normal(scale=0.02, size=(10, 64))
    tree = ct.build(spread / np.linalg.norm(spread, axis=1)[:, None], np.arange(2000))
    assert len(tree.children) > 1900
    pairs = {(a, b) for p, q in ct.dual_pairs(spread, np.arange(2000), None, 0.9, seen) for a, b in zip(p.tolist(), q.tolist())}
    assert {tuple(sorted(x)) for x in pairs} == {(i, 1000 + i) for i in range(10)} and seen["pruned"] > 0.99 * seen["tested"]


def test_repeats_beyond_leaves_and_two_sides():
    raw = np.concatenate([np.repeat(np.eye(4), 100, axis=0), np.random.default_rng(5).normal(size=(300, 4))])
    unit = raw / np.linalg.norm(raw, axis=1)[:, None]
    first, second = np.arange(0, 700, 2), np.arange(1, 700, 2)
    got = sorted((a, b) for p, q in ct.dual_pairs(raw, first, second, 0.97) for a, b in zip(p.tolist(), q.tolist()))
    i, j = np.nonzero(unit[first] @ unit[second].T >= 0.97)
    assert got == sorted(zip(first[i].tolist(), second[j].tolist()))


def test_lengths_that_the_sample_misses_and_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ct, "PIVOTS", 3)
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    vectors = [(i, v) for i, (_, v) in enumerate(clustered(4, 60, 5) + clustered(5, 60, 7) + clustered(6, 60, 9) + [(0, None)] * 40)]
    vectors += [(500 + i, vectors[0][1]) for i in range(40)]
    assert got(spark, vectors, block_rows=16) == brute(vectors)
