import math
import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import kn_model as kn
from quillspark.llm import quality

RNG = random.Random(3)
OWN = ["id", "text_key", "_row", "mean", "n", "half", "model", "rate"]


def sentence(n):
    return " ".join("".join(RNG.choice(["ka", "lo", "mi", "ren", "sto"]) for _ in range(RNG.randint(1, 4))) for _ in range(n)).capitalize() + "."


def build(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", *(f"{i} as {c}" for i, c in enumerate(OWN)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "5 as id")


def characters(text):
    return "".join(" " if c.isspace() else "0" if c.isdigit() else c for c in text)


def brute_model(texts):
    """Interpolated modified Kneser-Ney from its definition, over dictionaries and plain strings."""
    counts = {kn.ORDER: Counter()}
    for text in texts:
        line = kn.START * (kn.ORDER - 1) + characters(text) + kn.END
        counts[kn.ORDER].update(line[i : i + kn.ORDER] for i in range(len(line) - kn.ORDER + 1))
    for k in range(kn.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def chen_goodman(c):
        n1, n2, n3, n4 = (sum(n == i for n in c.values()) for i in range(1, 5))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5) if n1 else (0.5, 2 - 3 * 0.5 * n3 / n2 if n2 else 1.0, 3 - 4 * 0.5 * n4 / n3 if n3 else 1.5)
        return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]

    d = {k: chen_goodman(c) for k, c in counts.items()}
    totals = {k: {} for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            total, kept = totals[k].get(g[:-1], (0, 0.0))
            totals[k][g[:-1]] = (total + n, kept + d[k][min(n, 3) - 1])

    def p(k, g):
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        below = p(k - 1, g[1:])
        if g[:-1] not in totals[k]:
            return below
        total, kept = totals[k][g[:-1]]
        n = counts[k].get(g, 0)
        return (n - d[k][min(n, 3) - 1] if n else 0) / total + kept / total * below

    def perplexity(text):
        line = kn.START * (kn.ORDER - 1) + characters(text) + kn.END
        return math.exp(np.mean([-math.log(p(kn.ORDER, line[i : i + kn.ORDER])) for i in range(len(line) - kn.ORDER + 1)]))

    return perplexity


ROWS = [(i, sentence(RNG.randint(8, 40)), "xx" if i % 2 else "yy") for i in range(400)]
ROWS += [(1000 + i, " ".join("#%&" + chr(65 + RNG.randint(0, 25)) * 5 for _ in range(20)), "xx") for i in range(20)]
ROWS += [(2000, None, "xx"), (2001, "", None), (2002, "Ka.", "yy"), (None, ROWS[0][1], "zz"), (2003, sentence(60_000), "xx"), (5, ROWS[5][1], "xx"), (5, ROWS[5][1], "xx")]
ROWS += [(2004, "".join(chr(0x4E00 + RNG.randint(0, 3000)) for _ in range(300)), "xx"), (2005, sentence(20), None)]
LABELS = [(i, 1, 0) for i in range(300)] + [(i, 0, 0) for i in range(1000, 1010)] + [(300, 1, 1), (301, 1, 0), (301, 0, 0), (None, 1, 0)]
JUNK = set(range(1000, 1020)) | {2004}


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = build(spark, ROWS, LABELS)
    return docs, labels, quality.classify(docs, labels).collect()


def test_junk_goes_and_clean_text_stays(judged):
    _, _, out = judged
    assert len(out) == len(ROWS)
    assert {r["doc_id"] for r in out if not r["kept"]} == JUNK


def halves(spark):
    ids = spark.createDataFrame([(i,) for i, _, _ in ROWS], "id long")
    return {r["id"]: r["half"] for r in ids.select("id", quality.half_of("id").alias("half")).collect()}


def test_perplexity_against_the_definition(spark, judged):
    half = halves(spark)
    texts = dict((i, t) for i, t, _ in ROWS)
    models = [brute_model([t for i, t, _ in ROWS if i is not None and i < 300 and half[i] == h]) for h in (0, 1)]
    rows = [r for r in judged[2] if r["doc_id"] in (1000, 2000, 2002, 2004, *range(0, 400, 40))]
    assert len(rows) == 14
    for r in rows:
        assert r["perplexity"] == pytest.approx(models[1 - half[r["doc_id"]]](texts[r["doc_id"]] or ""), rel=1e-4)


def test_thresholds_against_the_definition(judged):
    """The quantile of the score by language, from the perplexities."""
    out = [r for r in judged[2] if r["doc_id"] is not None]
    held = [r for r in out if r["doc_id"] < 300]
    quarters = lambda rows, value: np.percentile([value(r) for r in rows], (25, 50, 75))
    scale = {}
    pooled = quarters(held, lambda r: r["score"])
    for lang in ("xx", "yy"):
        mine = [r for r in held if r["lang"] == lang]
        q, n = quarters(mine, lambda r: r["score"]), len(mine)
        scale[lang] = [(n * a + 20 * b) / (n + 20) for a, b in ((q[1], pooled[1]), (q[2] - q[0], pooled[2] - pooled[0]))]
    z = np.array([(r["score"] - scale[r["lang"]][0]) / scale[r["lang"]][1] for r in held])
    ninth = np.percentile(z, 90)
    high = ninth + (z[z > ninth] - ninth).mean() * math.log(1000)
    for r in out:
        if r["lang"] in scale:
            assert r["threshold"] == pytest.approx(scale[r["lang"]][0] + scale[r["lang"]][1] * high, rel=0.02)


def test_shards_add_up(judged):
    docs, labels, out = judged
    key = lambda r: (r["doc_id"] is None, r["doc_id"], str(r["lang"]))
    some = lambda rows: [(r["doc_id"], r["lang"], pytest.approx(r["perplexity"]), pytest.approx(r["lean"], abs=1e-6), r["kept"]) for r in sorted(rows, key=key)]
    again = quality.classify(docs, labels, shard_rows=3000).collect()
    assert some(again) == some(out)


def test_trusted_need_all_labels(judged):
    assert {r["id"] for r in quality.trusted_ids(judged[1]).collect()} == set(range(300))


def test_keep_good_keeps_columns(judged):
    docs, labels, _ = judged
    left = quality.keep_good(docs, labels)
    assert left.columns == docs.columns and left.count() == len(ROWS) - len(JUNK)


def test_nothing_trusted_and_empty(spark):
    docs, labels = build(spark, [(1, "#### $$$", "xx"), (2, None, None)], [(1, 0, 0)])
    assert [r["kept"] for r in quality.classify(docs, labels).collect()] == [True, True]
    assert [r["kept"] for r in quality.classify(docs, labels.where("false")).collect()] == [True, True]
    assert quality.classify(docs.where("false"), labels).count() == 0


def test_pieces_carry_their_past():
    text = "ab1 " * (kn.SLICE // 2) + "\ud800\x00end"
    lines = list(kn.pieces(text))
    assert len(lines) == len(text) // kn.SLICE + 1 and sum(len(x) - kn.ORDER + 1 for x in lines) == len(text) + 1
    assert (lines[1][: kn.ORDER - 1] == lines[0][-(kn.ORDER - 1) :]).all() and lines[-1][-1] == ord(kn.END)
    assert set(lines[0][kn.ORDER - 1 :].tolist()) == set(map(ord, "ab0 "))
    assert kn.discounts(0, 0, 0, 0) == (0.5, 1.0, 1.5)
