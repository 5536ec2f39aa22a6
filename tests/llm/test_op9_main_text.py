import re
from collections import Counter, defaultdict

from quillspark.llm import html_template
from quillspark.llm.html_parse import blocks

PROSE = ["river", "stone", "lamp", "orchard", "violin", "harbour", "candle", "meadow"]


def body(i):
    return " ".join(f"{PROSE[(i + k) % 8]}{i}{k}" for k in range(80))


def nested(i):
    return f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Title {i}</h1><p class='lede'>Lede {i}</p><div class='body'><p>{body(i)}</p></div></article><footer>Fixed foot</footer></body></html>"


def plain(i):
    return f"<html><body><p>Site name</p><p>Tag line</p><p>All rights</p><h1>Head {i}</h1><div><p>{body(i)}</p></div></body></html>"


def extract(spark, pages):
    rows = [(i, f"http://x.org/{i}", html) for i, html in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_template.extract_main_text(df).collect()}


def test_nested_bodies_keep_titles_and_ledes(spark):
    for i, text in extract(spark, [nested(i) for i in range(6)]).items():
        assert text.split("\n\n") == [f"Title {i}", f"Lede {i}", body(i)]


def test_text_beside_the_largest_element_stays_and_the_template_goes(spark):
    for i, text in extract(spark, [plain(i) for i in range(12)]).items():
        assert text.split("\n\n") == [f"Head {i}", body(i)]


def test_pages_of_another_layout(spark):
    odd = f"<html><body><h2>Odd head</h2><div><p>short text</p></div><section><p>{body(99)}</p></section></body></html>"
    out = extract(spark, [plain(i) for i in range(30)] + [odd])
    assert out[30].split("\n\n") == ["Odd head", "short text", body(99)]


def brute(pages, share=0.5, least=3):
    """The same from the definition, with whole vectors in dictionaries; ``pages`` are (url, html)."""
    by_host = defaultdict(set)
    for url, html in pages:
        if url and "://" in url:
            by_host[re.split("[/?#]", url.split("://", 1)[1])[0].lower()].add(html or "")
    closed = {}
    for host, htmls in by_host.items():
        vectors = defaultdict(Counter)
        for h in htmls:
            last = []
            for b in (b for b in blocks(h) if not b.chrome):
                parts = b.path.split("/")[1:]
                same = 0
                while same < min(len(parts), len(last)) and parts[same] == last[same]:
                    same += 1
                for depth in range(1, len(parts) + 1):
                    if depth > same or (parts == last and depth == len(parts)):
                        vectors["element", "/".join(parts[:depth])][h] += 1
                last = parts
                vectors["text", b.path, b.text][h] += 1
        n, groups = len(htmls), defaultdict(list)
        for token, vector in vectors.items():
            p = len(vector) / n
            low = (p + 1.96**2 / (2 * n) - 1.96 * (p * (1 - p) / n + 1.96**2 / (4 * n * n)) ** 0.5) / (1 + 1.96**2 / n)
            if low >= share:
                groups[frozenset(vector.items())].append(token)
        closed[host] = {t[1:] for g in groups.values() if len(g) >= least and any(t[0] == "element" for t in g) for t in g if t[0] == "text"}
    out = []
    for url, html in pages:
        fixed = closed.get(re.split("[/?#]", url.split("://", 1)[1])[0].lower(), set()) if url and "://" in url else set()
        held = [b for b in blocks(html or "") if not b.chrome]
        if any(b.article for b in held):
            held = [b for b in held if b.article]
            held = [b for b in held if (b.path, b.text) not in fixed] or held
        else:
            held = [b for b in held if (b.path, b.text) not in fixed]
        size = lambda s: sum(len(b.text) for b in held if b.side == s)  # noqa: E731, B023
        linked = lambda s: sum(b.linked for b in held if b.side == s)  # noqa: E731, B023
        whole = sum(len(b.text) for b in held)
        gone = {b.side for b in held if b.side and (b.side.startswith("comments") or linked(b.side) * 2 >= size(b.side) or size(b.side) * 2 <= whole)}
        out.append("\n\n".join(b.text for b in [b for b in held if b.side not in gone] or held))
    return out


def test_against_the_definition(spark):
    pages = [("http://a.org/1", nested(i)) for i in range(7)] + [("http://b.org/", plain(i)) for i in range(9)] + [("https://B.org/x", plain(i)) for i in range(9, 12)]
    pages += [("http://c.org/", f"<html><body><article><p>{body(i)}</p><p>Read more on this site</p><p>{body(i + 50)}</p></article>") for i in range(8)]
    pages += [("http://d.org/", plain(i)) for i in range(3)] + [("no host", plain(1)), (None, plain(2)), ("http://e.org", None), ("http://e.org", ""), ("http://e.org", "<p>cut off <b>he")]
    pages += [("http://c.org/same", pages[20][1])] * 3 + [("http://f.org/", "<p>" + "long text " * 200_000 + "</p>")]
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as page", "3 as packed", "'x' as text", "4 as n")
    want = brute(pages)
    for options in ({}, {"broadcast_keys": -1}):
        got = {r["page_id"]: r for r in html_template.extract_main_text(df, **options).collect()}
        assert [got[i]["text"] for i in range(len(pages))] == want
        assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    # the template decides: notices repeated in articles go, on three pages alone they stay
    assert want[19].split("\n\n") == [body(0), body(50)] and "Site name" in want[27] and "Site name" not in want[7]


def test_wrappers_and_names_do_not_empty_an_article(spark):
    wrapped = [f'<div class="layout with-sidebar"><div class="sidebar"><form><article><h1>Head {i}</h1><p>{body(i)}</p></article></form></div></div>' for i in range(6)]
    assert extract(spark, wrapped) == {i: f"Head {i}\n\n{body(i)}" for i in range(6)}
    named = f'<article><header class="post-header"><h1>T</h1></header><p class="related-work">{body(1)}</p><p class="comment">{body(2)}</p><div class="notice"><p>{body(3)}</p><p>{body(4)}</p><p>{body(5)}</p><p>{body(6)}</p></div></article>'
    text = extract(spark, [named])[0]
    assert "T\n\n" in text and body(1) in text and body(4) in text


def test_what_is_beside_the_text_goes(spark):
    page = (
        "<header>Site</header><nav><a>Home</a></nav><aside>Aside</aside><main><h1>Head</h1><div class='ad'>Buy this</div>"
        f"<p>{body(1)} &amp;\n more</p><div class='share'><a>Tweet</a></div><form>Name <input></form><script>x()</script><div hidden>h</div>"
        f"<section id='comments'><p>{body(2)}</p><p>{body(3)}</p><p>{body(4)}</p></section></main><footer>Foot</footer>"
    )
    assert extract(spark, [page])[0] == f"Head\n\n{body(1)} & more"


def test_copies_of_one_article_stay(spark):
    pages = [f"<article><h1>Same head</h1><p>{body(1)}</p></article><div>{i}</div>" for i in range(8)]
    assert set(extract(spark, pages).values()) == {f"Same head\n\n{body(1)}"}


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "http://x.org", "<p>a</p>")], "page_id long, url string, html string")
    assert html_template.extract_main_text(df.where("false")).count() == 0
