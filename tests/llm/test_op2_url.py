import math
import re
from collections import defaultdict

import pytest

from quillspark.llm import url_filter as uf

LETTERS = "abcdefghijklmnopqrstuvwxyz"
URLS = [f"https://good{c}.example.net/en/{c}{i}.html" for i, c in enumerate(LETTERS)] + [f"http://spam{c}.cheap.net/de/{i}{c}" for i, c in enumerate(LETTERS)] + ["http://goodc.example.org/en/7.html", "http://spamb.cheap.com/xx/1"]


def judged(spark, urls, **options):
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r["page_id"]: r for r in uf.judge(rows, **options).collect()}


def test_parts_and_rules(spark):
    cases = {
        "https://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/"),
        "http://example.net/de/": ("example.net", "/de/", "net/"),
        "http://x.example.com/de/1": ("x.example.com", "/de/1", "example.com/de/"),
        "http://notexample.com/de/1": ("notexample.com", "/de/1", None),
        "ftp://a.org/fr/": ("a.org", "/fr/", "org/fr/"),
        "http://a.net": ("a.net", "", None),
        "http://a.net?x=/": ("a.net", "", None),
        "http://a.net:80/": ("a.net:80", "/", None),
        "x://y://z.net/": ("y:", "//z.net/", None),
        "no scheme.net/": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
    }
    got = judged(spark, list(cases))
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(cases))] == list(cases.values())
    verdicts = {r.name: r.verdict for r in uf.RULES}
    assert all(g["verdict"] == verdicts[g["rule"]] for g in got.values() if g["rule"])


def brute_scores(urls, order=5, held_out=None):
    """Witten-Bell from its definition, over the training forms that the operator reports."""
    forms = {}
    for url, label, trains in urls:
        forms[url] = (label, trains)
    counts = {s: defaultdict(lambda: defaultdict(int)) for s in ("allow", "block")}
    alphabet = set()
    for form, (label, trains) in forms.items():
        line = uf.START * (order - 1) + form + uf.END
        for i in range(order - 1, len(line)):
            alphabet.add(line[i])
            if trains and label:
                for k in range(order):
                    counts[label][line[i - k : i]][line[i]] += 1

    def p(side, context, char):
        below = 1 / (len(alphabet) + 1) if not context else p(side, context[1:], char)
        if context == "":
            below = 1 / (len(alphabet) + 1)
        seen = counts[side].get(context)
        if not seen:
            return below
        return (seen.get(char, 0) + len(seen) * below) / (sum(seen.values()) + len(seen))

    scores = {}
    for form in forms:
        line = uf.START * (order - 1) + form + uf.END
        ratios = [math.log(p("allow", line[i - order + 1 : i], line[i])) - math.log(p("block", line[i - order + 1 : i], line[i])) for i in range(order - 1, len(line))]
        scores[form] = sum(ratios) / len(ratios)
    return scores


def test_scores_against_the_definition(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    forms = rows.select("page_id", uf.form_of(F.col("url")).alias("form")).withColumn("fold", F.pmod(F.xxhash64("form", F.lit("fold")), F.lit(5))).collect()
    fold = {r["page_id"]: (r["form"], r["fold"]) for r in forms}
    got = judged(spark, URLS)
    label = {i: got[i]["verdict"] if got[i]["rule"] else None for i in got}
    want = brute_scores([(fold[i][0], label[i], fold[i][1] != 0) for i in got])
    checked = 0
    for i, r in got.items():
        if r["rule"] is None:
            assert r["score"] == pytest.approx(want[fold[i][0]], abs=1e-9)
            checked += 1
    assert checked == 2 and got[52]["score"] > got[53]["score"]


def test_nothing_to_learn_repeats_and_empty(spark):
    got = judged(spark, ["http://a.com/x", "http://a.com/x", None])
    assert [g["verdict"] for g in got.values()] == ["allow"] * 3
    assert judged(spark, []) == {}


def test_form_folds_digits(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("HTTP://X.com/12/3a",), (None,)], "url string")
    assert [r[0] for r in df.select(uf.form_of(F.col("url"))).collect()] == ["x.com/0/0a", ""]
    assert re.match("x", "x")


def test_the_query_reads_whole_urls(spark, tmp_path):
    """URLs that differ in digits, case or scheme only are different text: each is learned from and judged by itself."""
    from pyspark.sql import functions as F

    urls = [f"https://shop{i}.example.net/en/{i}{i}" for i in range(40)] + [f"http://Shop{i}.cheap.net/xx/9{i}" for i in range(40)]
    open_urls = ["http://shop11.a.com/en/11", "http://shop99.a.com/en/97", "http://SHOP11.a.com/en/11", "https://shop11.a.com/en/11", "http://\x02a.com/x"]
    rows = spark.createDataFrame(list(enumerate(urls + open_urls)), "page_id long, url string")
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in uf.op2_url_ratio(spark, str(tmp_path)).collect()}
    assert len({got[i]["score"] for i in range(80, 84)}) == 4
    forms = rows.select("page_id", uf.whole_url(F.col("url")).alias("form")).withColumn("fold", F.pmod(F.xxhash64("form", F.lit("fold")), F.lit(5))).collect()
    want = brute_scores([(r["form"], got[r["page_id"]]["verdict"] if got[r["page_id"]]["rule"] else None, r["fold"] != 0) for r in forms])
    assert [got[i]["score"] for i in range(80, 85)] == pytest.approx([want[forms[i]["form"]] for i in range(80, 85)], abs=1e-9)
    assert forms[79]["form"] == urls[79]


def test_a_hot_form_is_salted(spark, monkeypatch):
    urls = URLS + [URLS[-1]] * 30 + [None] * 20
    want = [(i, r["verdict"], r["score"]) for i, r in sorted(judged(spark, urls, form=uf.whole_url).items())]
    monkeypatch.setattr(uf, "HOT_ROWS", 5)
    assert [(i, r["verdict"], r["score"]) for i, r in sorted(judged(spark, urls, form=uf.whole_url).items())] == want and len(want) == len(urls)
