import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillspark.llm import decontaminate as dc

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(400)]
ITEMS = [" ".join(RNG.choice(WORDS) for _ in range(n)) for n in (12, 25, 40, 60, 120, 300)] + ["too few words here", "", None, "solo"]


def filler(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def shingles(words):
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def similarity(a, b):
    low, high = sum((a & b).values()), sum((a | b).values())
    return low / high if high else 0.0


def brute(text, item):
    """The best weighted Jaccard similarity of the item with any window of its size."""
    words, want = ([w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for t in (text, item))
    if not want or not words:
        return 0.0
    own, n = shingles(want), len(want)
    return max(similarity(shingles(words[i : i + n]), own) for i in range(max(1, len(words) - n + 1)))


def changed(item, at):
    words = item.split()
    words[at] = "changed"
    return " ".join(words)


def run(spark, texts, items=ITEMS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as window", "2 as item_id", "'k' as text_key")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("*", "0 as place")
    return docs, bench


def test_against_every_window(spark):
    texts = [filler(200) for _ in range(10)] + [None, "", "...", filler(4)]
    texts += [f"{filler(30)}. {item.upper().replace(' ', ', ')}! {filler(50)}" for item in ITEMS[:6]]
    texts += [ITEMS[2], changed(ITEMS[3], 2), f"{filler(9)} {changed(ITEMS[4], 60)} {filler(5)}", f"{filler(9)} {changed(changed(ITEMS[5], 60), 200)} {filler(5)}"]
    texts += [f"{filler(20)} {' '.join(ITEMS[3].split()[:30])} {filler(40)}", "so we write too few words here again", "solo", " ".join([ITEMS[1].split()[0]] * 3000)]
    docs, bench = run(spark, texts)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.leaks(docs, bench).collect()}
    want = {(d, i): s for d, t in enumerate(texts) for i, item in enumerate(ITEMS) if (s := brute(t, item)) >= 0.8}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    left = {r["doc_id"] for r in dc.decontaminate(docs, bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want}
    assert dc.decontaminate(docs, bench).columns == docs.columns


def test_empty_tables_and_repeats(spark):
    docs, bench = run(spark, [ITEMS[0], ITEMS[0]])
    assert dc.leaks(docs, bench.where("false")).count() == 0 and dc.leaks(docs.where("false"), bench).count() == 0
    assert dc.decontaminate(docs.unionByName(docs), bench).count() == 0


def test_simhash_is_the_majority(spark):
    words = ["alpha", "beta", "gamma", "beta"]
    df = spark.createDataFrame([(words,)], "t array<string>")
    row = df.select(dc.simhash(F.col("t")).alias("s"), F.transform("t", lambda w: F.xxhash64(w)).alias("h")).first()
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in row["h"]) * 2 > len(words))
    assert row["s"] & (2**64 - 1) == want


def test_multi_index_finds_all_within_the_radius(spark):
    masks = [m for m in range(256) if bin(m).count("1") <= dc.RADIUS // dc.BLOCKS]
    for _ in range(300):
        a, b = RNG.getrandbits(64), 0
        flips = RNG.sample(range(64), RNG.randint(0, dc.RADIUS))
        b = a
        for f in flips:
            b ^= 1 << f
        assert any(((a ^ b) >> 8 * k & 255) in masks for k in range(8))


def edited(words, rng):
    """One kind of edit that leaves about nine tenths of the shingles."""
    words, n = list(words), len(words)
    kind = rng.choice(["head", "tail", "drop", "add", "replace", "halves", "longest"])
    few = max(1, n // 12)
    if kind == "head":
        words[:few] = [f"h{i}" for i in range(few)]
    elif kind == "tail":
        words[-few:] = [f"t{i}" for i in range(few)]
    elif kind == "drop":
        del words[n // 2 : n // 2 + max(1, few // 2)]
    elif kind == "add":
        words[n // 3 : n // 3] = ["more"] * max(1, few // 2)
    elif kind == "replace":
        words[rng.randrange(n)] = "other"
    elif kind == "halves":
        words = words[n // 2 :] + words[: n // 2]
    else:
        for i in sorted(range(n), key=lambda i: -len(words[i]))[:1]:
            words[i] = "x"
    return words


def test_recall_under_edits(spark):
    rng = random.Random(9)
    items = [" ".join(rng.choice(WORDS) for _ in range(rng.choice((30, 60, 61, 90, 150)))) for _ in range(40)]
    # the longest words stand together at the head, and all of them are replaced
    heads = [" ".join(["extraordinarily", "incomprehensible", "counterrevolution", "uncharacteristic", "internationalism"] + [rng.choice(WORDS) for _ in range(55)]) for _ in range(20)]
    texts = [f"{filler(25)} {' '.join(edited(i.split(), rng))} {filler(25)}" for i in items for _ in range(8)]
    texts += [f"{filler(9)} {' '.join(['q'] * 5 + i.split()[5:])} {filler(9)}" for i in heads]
    texts += [" ".join(i.split()[: int(len(i.split()) * 0.84)]) for i in items]  # the document is a cut item
    docs, bench = run(spark, texts, items + heads)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.leaks(docs, bench).collect()}
    source = [i for i in range(40) for _ in range(8)] + list(range(40, 60)) + list(range(40))
    want = {(d, source[d]): s for d, t in enumerate(texts) if (s := brute(t, (items + heads)[source[d]])) >= 0.8}
    assert len(want) > 150 and all((320 + i, 40 + i) in want for i in range(20))
    found = sum(abs(got.get(k, 0) - s) < 1e-9 for k, s in want.items())
    assert found >= 0.99 * len(want)


def test_a_benchmark_that_is_not_broadcast(spark):
    texts = [f"{filler(30)} {ITEMS[3]} {filler(5)} {ITEMS[1]}", "solo", filler(300), None]
    docs, bench = run(spark, texts)
    rows = lambda **o: sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in dc.leaks(docs, bench, **o).collect())
    assert rows() == rows(broadcast_bytes=0) and len(rows()) == 3
