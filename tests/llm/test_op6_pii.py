import hashlib
import math
import re
import time

from quillspark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "",
    "é mail a.b+c@x-y.co.uk, and a@b, a@b@c.d then x@a.b@c.d @e.f g@.h",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1..2.3.4 1.2.3 999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559 4111  1111",
    "+1 (706) 555-3138 +44 20 7946 0958- +1 2 +123 +1234567890123456789 ++49 30 1234567",
    "7" * 5000 + "." + "8" * 5000 + " " + "a" * 5000 + "@" + "b" * 5000 + ".c",
    "+" + "1 " * 4000 + "x" + " 4644348398010899",
]


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0,
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_against_the_patterns():
    for text in TEXTS:
        assert pii.base_spans(text) == brute(text), text[:60]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "'x' as spans", "2 as entities", "3 as term")


def words(text):
    return set(re.findall(r"[^\W_]+", text.lower()))


def brute_disclosures(rows, min_support=2, min_bits=6.0, generalise_at=0.5):
    """(entity, term) -> (posterior, bits) from the definition, every row a document."""
    texts = [t or "" for _, t in rows]
    held = [({pii.entity_of(k, t[s:e]) for k, s, e in brute(t)}, words("".join(" " if any(s <= i < e for _, s, e in brute(t)) else c for i, c in enumerate(t))), words(t)) for t in texts]
    found = {}
    for e in {e for es, _, _ in held for e in es}:
        with_e = [terms for es, terms, _ in held if e in es]
        for term in set().union(*with_e):
            pair, total = sum(term in ts for ts in with_e), sum(term in every for _, _, every in held)
            if pair >= min_support and pair / total >= generalise_at and (bits := math.log2(pair * len(rows) / (total * len(with_e)))) >= min_bits:
                found[e, term] = (pair / total, bits)
    return found


ROWS = [(i, f"the night clerk Zanzibor wrote to spy@home.org again number {i}, and long {'filler ' * 60}afterwards came Quexley") for i in range(5)]
ROWS += [(10_000 + i, f"the clerk wrote again about number {i} and nothing else, a long filler afterwards, came") for i in range(1500)]
ROWS += [(900, "Halfling seen near spy@sea.org"), (901, "Halfling seen near spy@sea.org"), (902, "halfling near spy@sea.org"), (903, "a halfling alone"), (904, "halfling walks"), *((905 + i, "near here") for i in range(9))]
ROWS += [(950, None), (None, "spy@home.org"), (0, ROWS[0][1]), *((960 + i, f"halfway {i}") for i in range(40))]


def test_disclosing_terms_go(spark):
    out = pii.sanitise(docs(spark, ROWS), keep_text=True).collect()
    assert len(out) == len(ROWS)
    by_id = {r["doc_id"]: r for r in out}
    kinds = lambda i: [(s["kind"], (dict(ROWS)[i] or "")[s["start"] : s["end"]]) for s in by_id[i]["spans"]]
    told = brute_disclosures(ROWS)
    for i in (1, 900, 902):
        text = dict(ROWS)[i]
        have = {pii.entity_of(k, text[s:e]) for k, s, e in brute(text)}
        want = {t for e, t in told if e in have}
        assert {x.lower() for kind, x in kinds(i) if kind.startswith("term")} == want & words(text) and want
    # however far from the entity
    assert {x for kind, x in kinds(1) if kind == "term_removed"} >= {"Zanzibor", "Quexley"}
    assert ("term_generalised", "Halfling") in kinds(900) and kinds(903) == [] and kinds(950) == [] and kinds(10_000) == []
    assert by_id[900]["text"].startswith("half* ") and "[EMAIL]" in by_id[1]["text"] and "Zanzibor" not in by_id[1]["text"] and by_id[950]["text"] == ""
    assert by_id[1]["text"].startswith("the ") and " clerk " in by_id[1]["text"]
    for r in out:
        base = brute(dict(ROWS).get(r["doc_id"]) or "") if r["doc_id"] is not None else brute("spy@home.org")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
    assert sum(r["doc_id"] == 0 and len(r["spans"]) > 1 for r in out) == 2  # repeated rows each get their spans


def test_terms_against_counting(spark):
    rows = [(i, f"alpha{i % 3} beta gamma{i % 2} a{i % 4}@x.org delta{i % 4} omega, and b{i % 8}@y.org") for i in range(40)] + [(100 + i, "beta omega alpha0 filler") for i in range(400)]
    plain = docs(spark, rows).selectExpr("doc_id", "xxhash64(cast(doc_id as string), text) as key", "text")
    found = pii.find(plain, False).persist()
    options = {"min_support": 3, "min_bits": 1.0}
    classes = pii.entity_classes(found, len(rows), **options).persist()
    keys_of: dict = {}
    for r in classes.collect():
        keys_of.setdefault(r["class"], set()).add(r["key"])
    class_by_keys = {frozenset(keys): c for c, keys in keys_of.items()}
    holds: dict = {}
    for r in found.select("key", "entities").collect():
        for e in r["entities"]:
            holds.setdefault(e, set()).add(r["key"])
    got = {(r["class"], r["term"]): (r["posterior"], r["bits"]) for r in pii.disclosures(classes, pii.places_of(plain, classes.select("key")), plain, len(rows), generalise_at=0.2, **options).collect()}
    want = brute_disclosures(rows, 3, 1.0, 0.2)
    expected = {(class_by_keys[frozenset(holds[e])], t): v for (e, t), v in want.items()}
    assert expected and got.keys() == expected.keys()
    assert all(abs(got[k][i] - v[i]) < 1e-9 for k, v in expected.items() for i in (0, 1))


def test_many_entities_in_a_document_are_linear(spark):
    many = " ".join(f"user{i}@mail{i}.org said word{i}" for i in range(20_000))
    start = time.perf_counter()
    out = pii.sanitise(docs(spark, [(1, many), (2, many), *((3 + i, f"word{i} other") for i in range(300))])).collect()
    assert time.perf_counter() - start < 60
    spans = {r["doc_id"]: r["spans"] for r in out}
    assert sum(s["kind"] == "email" for s in spans[1]) == 20_000 and sum(s["kind"] == "term_removed" for s in spans[1]) > 19_000


def test_empty_table(spark):
    assert pii.sanitise(docs(spark, [(1, "x")]).where("false")).count() == 0
