"""Information-theoretic sanitisation of personal data (operator 6).

Patterns find the protected entities: mail addresses, IPv4 addresses, payment cards, phone numbers.
Corpus co-occurrence then says how strongly the other words of a document reveal an entity. With n(t, e)
the documents that hold term t and entity e, n(t) and n(e) those with t or e anywhere, and N all
documents, t discloses e if

* n(t, e) >= ``min_support``, that is, the two were seen together again,
* log2(n(t, e) * N / (n(t) * n(e))) >= ``min_bits`` (pointwise mutual information), and
* n(t, e) / n(t) >= ``generalise_at`` (the posterior of e given t).

From a posterior of ``remove_at`` the term is removed, below it generalised, at every place in the
documents that hold e, however far from it. A term is generalised to the longest of its prefixes of
``PREFIXES`` characters whose posterior is below ``generalise_at`` (n(e) over the documents with a word
of that prefix, from the same counts), as ``ha*``, and to ``[TERM]`` if there is none.

All counts are over all documents and whole texts, repeated rows each. As only n(t, e) and n(e) matter, entities held by the same documents are one: a document with 20,000 addresses
is one class of entities times its different words. Entities of fewer than ``min_support`` documents, and
those so common that no term can reach ``min_bits``, are left out before anything is paired. Document
frequencies are counted for candidate terms and prefixes alone: a bitmap of ``BITMAP_BITS`` bits (that is
its proven size) passes them in the one scan over all words; a false hit drops out in the exact join.

Nulls and odd cases: a null text is empty; null ids are kept; repeated rows each get their spans; an
empty table gives an empty result; long texts cost in proportion to their length; where a term discloses
several entities the one of the highest posterior (ties: removal) decides; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_bitmap, key_bitmap, salt, spread, table

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("term_removed", "term_generalised")
PREFIXES = (4, 2)
SALTS = 8

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: A dotted number can only begin where its digits do, so runs of digits are read once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]+")
DIGIT = re.compile(r"[0-9]")
SEPARATORS = str.maketrans("", "", " -().+")

SPAN = "array<struct<kind:string,start:long,end:long>>"
FOUND = f"doc_id long, key long, text string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base {SPAN}, entities array<string>"
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
ARROW_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("key", pa.int64()), ("text", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("base", ARROW_SPAN), ("entities", pa.list_(pa.string()))]
)
PLACES = "array<struct<start:long,end:long>>"
ARROW_TERMS = pa.schema([("key", pa.int64()), ("term", pa.string()), ("places", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern would, but each stretch before an ``@`` is read once, from the ``@`` back."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in ``KINDS``, then start; code points, end exclusive."""
    spans = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return spans
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].translate(SEPARATORS)
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def entity_of(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else value.translate(SEPARATORS)}"


def terms_of(text: str) -> dict[str, list[tuple[int, int]]]:
    """The lower-cased words of a text and their places, but for words that touch a base span; one pass over both in order."""
    taken = sorted((s, e) for _, s, e in base_spans(text))
    found: dict[str, list[tuple[int, int]]] = {}
    reach, i = 0, 0
    for m in TERM.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= m.start():
            found.setdefault(m[0].lower(), []).append(m.span())
    return found


def find(docs: DataFrame, keep_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                for i, kind in enumerate(KINDS):
                    columns[i].append(sum(s[0] == kind for s in spans))
                columns[4].append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest())
                columns[5].append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                columns[6].append(list({entity_of(k, text[s:e]) for k, s, e in spans}))
            kept = batch.column("text") if keep_text else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), kept, *(pa.array(c, f.type) for c, f in zip(columns, list(ARROW_FOUND)[3:]))], schema=ARROW_FOUND)

    return docs.mapInArrow(run, FOUND)


def entity_classes(found: DataFrame, n_all: int, min_support: int, min_bits: float) -> DataFrame:
    """``(key, class, n_entity, copies)``: for each document (``copies`` rows) the classes of entities that the same documents hold."""
    held = found.where("size(entities) > 0").select("key", F.explode("entities").alias("entity")).groupBy("key", "entity").agg(F.count("*").alias("copies"))
    print_of = F.sum(F.xxhash64("key").cast("decimal(38,0)")).cast("string")
    entities = held.groupBy("entity").agg(F.sum("copies").alias("n_entity"), print_of.alias("print"))
    # n(t, e) <= n(t), so no term has more bits than log2(N / n(e))
    able = entities.where((F.col("n_entity") >= min_support) & (F.log2(F.lit(float(max(n_all, 1))) / F.col("n_entity")) >= min_bits))
    able = able.withColumn("class", F.xxhash64("n_entity", "print")).drop("print")
    return held.join(able, "entity").groupBy("key", "class").agg(F.max("n_entity").alias("n_entity"), F.max("copies").alias("copies"))


def places_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, term, places)``: the words of the documents of ``keys(key)`` (and of a few others)."""
    shared = docs.sparkSession.sparkContext.broadcast(key_bitmap(keys, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                if in_bitmap(shared.value, str(key)):
                    rows += [(key, term, [{"start": s, "end": e} for s, e in places]) for term, places in terms_of(text.as_py()).items()]
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW_TERMS)], schema=ARROW_TERMS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW_TERMS)], schema=ARROW_TERMS)

    return docs.select("key", "text").mapInArrow(run, f"key long, term string, places {PLACES}").groupBy("key", "term").agg(F.first("places").alias("places"))


def prefixes(term: str) -> list[str]:
    return [f"{term[:n]}*" for n in PREFIXES if len(term) > n]


def document_frequency(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, n_term)``: in how many of ``docs(key, text)`` each of ``terms(term)`` occurs; ``ab*`` is any word that begins so."""
    shared = docs.sparkSession.sparkContext.broadcast(key_bitmap(terms, "term"))
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts, known = shared.value, {}, {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                hits: set[str] = set()
                for term in set(TERM.findall(text.lower())):
                    passed = known.get(term)
                    if passed is None:
                        if len(known) > 200_000:
                            known.clear()
                        passed = known[term] = tuple(x for x in (term, *prefixes(term)) if in_bitmap(bits, x))
                    hits.update(passed)
                for x in hits:
                    counts[x] = counts.get(x, 0) + 1
            if len(counts) > 100_000:
                yield pa.RecordBatch.from_pydict({"term": list(counts), "n": list(counts.values())}, schema=schema)
                counts = {}
        if counts:
            yield pa.RecordBatch.from_pydict({"term": list(counts), "n": list(counts.values())}, schema=schema)

    return docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term")).join(terms, "term", "left_semi")


def disclosures(classes: DataFrame, places: DataFrame, docs: DataFrame, n_all: int, *, min_support: int = 2, min_bits: float = 6.0, generalise_at: float = 0.5, remove_at: float = 0.9) -> DataFrame:
    """``(class, term, kind, posterior, bits, general)`` for the terms that disclose the entities of a class."""
    together = classes.join(places.select("key", "term"), "key").groupBy("class", "term").agg(F.sum("copies").alias("n_pair"), F.max("n_entity").alias("n_entity"))
    pairs = cut(together.where(F.col("n_pair") >= min_support), "pairs")
    shorter = [F.when(F.length("term") > n, F.concat(F.left("term", F.lit(n)), F.lit("*"))) for n in PREFIXES]
    wanted = pairs.select(F.explode(F.array("term", *shorter)).alias("term")).where("term is not null").distinct()
    counted = cut(document_frequency(docs, wanted), "frequencies")
    bits = F.log2(F.col("n_pair").cast("double") * F.lit(n_all) / (F.col("n_term").cast("double") * F.col("n_entity")))
    scored = pairs.join(counted, "term").withColumn("posterior", F.col("n_pair") / F.col("n_term")).withColumn("bits", bits)
    scored = scored.where((F.col("posterior") >= generalise_at) & (F.col("bits") >= min_bits))
    general = F.lit("[TERM]")
    for i, n in reversed(list(enumerate(PREFIXES))):
        of = counted.select(F.col("term").alias(f"_{i}"), F.col("n_term").alias(f"_n{i}"))
        scored = scored.join(of, shorter[i] == F.col(f"_{i}"), "left")
        general = F.when(F.col("n_entity") / F.col(f"_n{i}") < generalise_at, F.col(f"_{i}")).otherwise(general)
    return scored.select("class", "term", F.when(F.col("posterior") >= remove_at, TERM_KINDS[0]).otherwise(TERM_KINDS[1]).alias("kind"), "posterior", "bits", general.alias("general"))


EXTRA = "array<struct<start:bigint,end:bigint,kind:string,mark:string>>"


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, min_support: int = 2, min_bits: float = 6.0, **thresholds) -> DataFrame:
    """One row per document: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans array, text).

    ``spans`` holds the base spans by kind and start, then the term spans by start. ``text`` is the
    sanitised text with ``keep_text``, else null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).alias("key"), text.alias("text"))
    found = cut(find(plain, keep_text), "found")
    n_all = found.count()
    classes = cut(entity_classes(found, n_all, min_support, min_bits), "classes")
    places = cut(places_of(plain, classes.select("key").distinct()).join(classes.select("key").distinct(), "key", "left_semi"), "places")
    told = cut(disclosures(classes, places, plain, n_all, min_support=min_support, min_bits=min_bits, **thresholds), "told")
    of_document = classes.select("key", "class").join(told, "class").groupBy("key", "term").agg(F.max_by(F.struct("kind", "general"), F.struct("posterior", "kind")).alias("x"))
    mark = F.when(F.col("x.kind") == TERM_KINDS[0], "").otherwise(F.col("x.general"))
    each = of_document.join(places, ["key", "term"]).select("key", F.explode("places").alias("place"), F.col("x.kind").alias("kind"), mark.alias("mark"))
    extra = cut(each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place.start", "place.end", "kind", "mark"))).alias("extra")), "extra")  # spans of one document
    joined = salt(found.drop("entities"), F.monotonically_increasing_id(), SALTS).join(spread(extra, SALTS), ["key", "_salt"], "left")
    extra = F.coalesce("extra", F.array().cast(EXTRA))
    plain_extra = F.transform(extra, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    base_marks = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("mark")))
    clean = redacted(F.col("text"), F.concat(base_marks, extra)) if keep_text else F.col("text")
    return joined.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.concat("base", plain_extra).alias("spans"), clean.alias("text"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span(start, end, kind, mark) replaced by its mark; where spans overlap the first one counts."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(
        F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), x["mark"]).alias("out"))
    )
    return F.aggregate(F.array_sort(spans), begin, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def spans_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6_pii_disclosure(spark, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents")).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", spans_string(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
