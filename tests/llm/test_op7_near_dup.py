import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import common
from quillspark.llm import near_dup as nd
from quillspark.llm.shingles import shingles_of, words_by_text

RNG = random.Random(9)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]


def text(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def edited(t, n):
    words = t.split()
    for at in RNG.sample(range(len(words)), n):
        words[at] = RNG.choice(VOCAB)
    return " ".join(words)


def shingles(t):
    words = re.findall(r"\w+", (t or "").lower())
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def idf(rows):
    """ln(1 + N / df) of every word, by counting."""
    df = Counter(w for _, t in rows for w in set(re.findall(r"\w+", (t or "").lower())))
    return {w: np.log1p(len(rows) / n) for w, n in df.items()}


def classes(rows, threshold=0.8, measure="plain"):
    """Transitive closure of equal words, or of the measure's Jaccard similarity at the threshold, over all pairs."""
    of = idf(rows)
    weigh = (lambda s: {x: n * sum(of[w] for w in x) / len(x) for x, n in s.items()}) if measure == "weighted" else (lambda s: s)
    sets = [(i, t, weigh(shingles(t)), shingles(t)) for i, t in rows]
    low = {i: i for i, _ in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, (i, s, x, p) in enumerate(sets):
        for j, t, y, q in sets[a + 1 :]:
            same = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
            both = sum(x.values()) + sum(y.values()) - same
            if (both and same / both >= threshold) or (not both and (s or "") == (t or "")) or (p and p == q):
                m, n = sorted((find(i), find(j)))
                low[n] = m
    return {i: find(i) for i, _ in rows}


def build(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as rep", "3 as component", "4 as _row")


def corpus():
    rows = [text(RNG.randint(30, 80)) for _ in range(150)]
    base = text(200)
    rows += [edited(base, RNG.randint(0, 3)) for _ in range(40)]  # one large bucket of different texts
    rows += [base] * 30 + [edited(rows[k], 1) for k in range(10)] + [rows[20].upper().replace(" ", ", "), "four words are few", "Four words, are few!", "", None, "?!", "!!", "..."]
    rows += [text(20000)]
    RNG.shuffle(rows)
    return list(enumerate(rows))


def together(c):
    return {frozenset(i for i in c if c[i] == k) for k in set(c.values())}


def inside(groups, whole):
    return all(len({whole[i] for i in group}) == 1 for group in groups)


@pytest.mark.parametrize("measure", nd.MEASURES)
def test_each_measure_against_all_pairs(spark, measure):
    rows = corpus()
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(build(spark, rows), small_bucket=4, link_by=(measure,)).collect()}
    # hashed counters and single precision leave a thousandth of doubt at the threshold
    assert inside(together(classes(rows, 0.801, measure)), got) and inside(together(got), classes(rows, 0.799, measure))


def test_both_measures_against_all_pairs(spark):
    rows = corpus()
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(build(spark, rows), small_bucket=4).collect()}
    assert inside(together(classes(rows, 0.801)), got) and inside(together(classes(rows, 0.801, "weighted")), got)
    assert inside(together(got), classes(rows, 0.75))


def test_a_bucket_of_unlike_texts_and_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    base = text(60)
    rows = [f"{base} {text(n)}" for n in range(0, 60, 2)] + [base] * 5 + [None] * 6
    rows = list(enumerate(rows))
    # one band of one sample: nearly all fall into one bucket, most of them unlike
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(build(spark, rows), samples=16, bands=16, small_bucket=2, link_by=("plain",)).collect()}
    assert together(got) == together(classes(rows))


def test_rows_nulls_and_repeats(spark):
    a, b = text(50), text(50)
    rows = [(3, a), (1, a), (None, a), (2, b), (2, b), (2, a), (7, text(50))]
    out = nd.near_duplicates(build(spark, rows)).collect()
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in out), key=str)
    assert got == sorted([(3, 1, False), (1, 1, True), (None, None, True), (2, 1, False), (2, 1, False), (2, 1, False), (7, 7, True)], key=str)
    assert nd.near_duplicates(build(spark, rows).where("false")).count() == 0


def test_keep_one(spark):
    a, b = text(50), text(60)
    docs = build(spark, [(5, a), (4, a), (4, a), (6, b), (None, b)])
    left = nd.keep_one(docs)
    assert left.columns == docs.columns and sorted((r["doc_id"] or -1) for r in left.collect()) == [-1, 4, 6]


def test_samples_agree_like_the_weighted_similarity():
    sampler = nd.Sampler(4096, 4096)
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(1 << 62, size=300).astype(np.uint64))
    x, y = rng.uniform(1, 5, 300), None
    y = np.where(rng.random(300) < 0.3, rng.uniform(1, 5, 300), x)
    agree = (sampler.draw(keys[:260], x[:260]) == sampler.draw(keys[40:], y[40:])).mean()
    want = nd.jaccard((keys[:260], x[:260]), (keys[40:], y[40:]))
    assert abs(agree - want) < 0.04


def test_word_hashes_are_those_of_the_words():
    texts = ["Ab c_d, é1 x", None, "", "ab", "AB ab", "zz" * 3000]
    found = list(words_by_text(pa.array(texts)))
    assert [len(w) for w in found] == [4, 0, 0, 1, 2, 1] and found[0][0] == found[3][0] == found[4][1]
    assert len(shingles_of(found[0])) == 1 and len(shingles_of(found[1])) == 0


def sketched(texts):
    """(sketches, (keys, weights, counts)) of texts, all words alike in idf."""
    sets = [nd.weighted(w, np.linspace(0.5, 9, nd.COUNTERS)) for w in words_by_text(pa.array(texts))]
    return [k.astype(np.uint32).tobytes() + nd.rounded_up(w).tobytes() + nd.rounded_up(c).tobytes() for k, w, c in sets], sets


@pytest.mark.parametrize("measure", nd.MEASURES)
def test_sketches_lose_no_pair_and_leave_few_others(measure):
    bases = [text(n) for n in (3, 8, 90, 400, 420)]
    texts = [edited(b, RNG.randint(0, max(1, len(b.split()) // k))) for b in bases for k in (4, 9, 12, 20, 40) for _ in range(6)]
    texts += ["again " * 90_000, "again " * 80_000, "again " * 70_000 + "once more then", "x"]
    found, sets = sketched(texts)
    made = set(zip(*(x.tolist() for x in nd.may_reach(found, found, 0.8, (measure,)))))
    column = 1 if measure == "weighted" else 2
    alike = {(i, j): nd.jaccard((a[0], a[column]), (b[0], b[column])) for i, a in enumerate(sets) for j, b in enumerate(sets)}
    assert {p for p, x in alike.items() if x >= 0.8} <= made
    # the last four: sums beyond half precision bound nothing
    unlike = [p for p, x in alike.items() if x < 0.7 and max(p) < len(texts) - 4]
    assert len(unlike) > 8000 and sum(p in made for p in unlike) < 0.02 * len(unlike)


def test_a_large_bucket_of_unlike_texts_verifies_few_pairs(spark, monkeypatch):
    """Copies with many changes share bands but are below the threshold: their pairs grew with the square of the bucket."""
    counted, whole = [], nd.verified
    monkeypatch.setattr(nd, "verified", lambda pairs, *rest: (counted.append(pairs.count()), whole(pairs, *rest))[1])
    monkeypatch.setattr(nd, "BLOCK_ROWS", 16, raising=False)
    base = text(200)
    rows = [edited(base, 14) for _ in range(60)]
    rows += [edited(rows[7], 1), edited(rows[9], 1), edited(edited(rows[7], 1), 1)]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(build(spark, rows), samples=16, bands=16, small_bucket=4, link_by=("plain",)).collect()}
    assert together(got) == together(classes(rows)) and len(together(got)) > 50
    assert len(counted) == 2 and counted[1] < 200


def plain_samples(sampler, keys, weights):
    """(key, level) of every sample, with a computed for every element as improved consistent weighted sampling defines it."""
    first = keys[:, None] * sampler.odd[None, :]
    first ^= first >> np.uint64(32)
    first *= nd._STEP
    first ^= first >> np.uint64(29)
    second = first * nd._MIX
    second ^= second >> np.uint64(32)
    uniform = lambda half: (half.astype(np.float64) + 0.5) * 2.0**-32
    low, high = np.uint64((1 << 32) - 1), np.uint64(32)
    r, c = (-np.log(uniform(x & low) * uniform(x >> high)) for x in (first, second))
    beta = ((second * nd._STEP) >> np.uint64(40)).astype(np.float64) * 2.0**-24
    level = np.floor(np.log(weights)[:, None] / r + beta)
    ln_a = np.log(c) - r * (level - beta) - r
    at = ln_a.argmin(axis=0)
    return keys[at], level[at, np.arange(sampler.samples)]


def test_samples_are_those_of_all_elements_though_few_are_computed(monkeypatch):
    """Before, a was computed for each element and sample, most of the time of the whole operator."""
    monkeypatch.setattr(nd, "PIECE", 256)
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 2, 7, 300, 1, 5000, 40, 900):
        weights = rng.uniform(0.7, 12, n) * rng.integers(1, 4, n)
        weights[rng.random(n) < 0.01] *= 1e5  # repeated lines
        sets.append((np.sort(rng.integers(1 << 62, size=n).astype(np.uint64)), weights))
    sampler, computed = nd.Sampler(64, 64), []
    whole = nd.Sampler.scores
    monkeypatch.setattr(nd.Sampler, "scores", staticmethod(lambda first, *rest: (computed.append(first.size), whole(first, *rest))[1]))
    got = sampler.draw_all(sets)
    assert sum(computed) < 0.2 * 64 * sum(len(k) for k, _ in sets)
    differ = 0
    for (keys, weights), drawn in zip(sets, got):
        key, level = plain_samples(sampler, keys, weights)
        differ += (drawn != nd.mix64(nd.mix64(key ^ (level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))).sum()
        assert (sampler.draw(keys, weights) == drawn).all()
    assert differ <= 2  # single precision at a tie
