"""Main text by equivalence-class template deduction (operator 9).

Over the different pages of a host, every token (an element by its path, or a text in its place) has an
occurrence vector: how often it occurs in each page. Tokens with equal vectors form a class. A class is
valid if it has ``min_tokens`` tokens, an element among them, and occurs on so many pages of the host
that the share is surely ``support_share`` (the lower Wilson bound, which two or three pages cannot
reach, and four that agree can). Valid classes nest by the paths of their elements, and together are
the host's template. What they fix, the texts that are their members, is closed; what they leave open are
the slots, and a page's main text is what fills them, in and outside articles:

* what the markup says is no text of the page (menus, headers, footers, asides, forms, scripts, what is
  hidden or has such a role) fills no slot; a form or a named element around an article is not asked;
* of a page with an ``article`` or ``main`` element only the slots in there count;
* closed text goes, wherever it stands. An article in which the template leaves nothing open (all pages of
  the host are versions of it) is kept whole;
* an element with a class or id whose whole name hints at an advert, a notice or the like goes only if its
  slot bears that out: at least half of its text is links, or it holds at most half of what fills the
  page's slots. Reader comments go if anything is left.

Vectors are never gathered: a vector is carried as the sum of a hash of (page, count), which is a
partial aggregate, so a host with a third of all pages needs no task of its own. Pages are parsed once,
and travel as compressed blocks, not as HTML. A host's closed texts are no more than twice the texts of a
page; they are broadcast behind a count, else the join with them is salted.

Nulls and odd cases: null or empty html gives an empty text; a null url has no host, and so no template;
pages may break off anywhere; long pages cost in proportion; repeated ids are separate pages, pages of
equal html count once in a vector; an empty table gives an empty result; other columns are ignored. White
space is what Unicode calls so.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salt, spread, table
from .html_parse import Block, blocks

SALTS = 16
BROADCAST_KEYS = 1_000_000  # of 8 bytes
Z = 1.96
TOKENS = pa.schema([("host", pa.string()), ("page", pa.int64()), ("path", pa.string()), ("text_key", pa.int64()), ("n", pa.int64())])
CARRIED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("page", pa.int64()), ("packed", pa.binary())])


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, in lower case; empty without ``://``."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def _text_key(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _pack(found: list[Block]) -> bytes:
    rows = [(b.path, b.text, b.article, b.linked, b.side) for b in found if not b.chrome]
    return json.dumps(rows, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")


def _unpack(data: bytes) -> list[Block]:
    return [Block(path, text, False, article, linked, side) for path, text, article, linked, side in json.loads(data.decode("utf-8", "surrogatepass"))]


def parsed(pages: DataFrame) -> DataFrame:
    """``(page_id, url, host, page, packed)`` of ``pages(page_id, url, host, page, html)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [pack.compress(_pack(blocks(html))) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host", "page")), pa.array(packed, pa.binary())], schema=CARRIED)

    return pages.mapInArrow(run, "page_id long, url string, host string, page long, packed binary")


def _tokens(host: str, page: int, found: list[Block]) -> Iterator[tuple]:
    elements: Counter = Counter()
    texts: Counter = Counter()
    last: tuple[str, ...] = ()
    for block in found:
        parts = tuple(block.path.split("/")[1:])
        same = next((i for i, (a, b) in enumerate(zip(parts, last)) if a != b), min(len(parts), len(last)))
        for depth in range(len(parts) if parts == last else same + 1, len(parts) + 1):
            elements["/" + "/".join(parts[:depth])] += 1
        last = parts
        texts[block.path, _text_key(block.path, block.text)] += 1
    for path, n in elements.items():
        yield host, page, path, None, n
    for (path, key), n in texts.items():
        yield host, page, path, key, n


def tokens(carried: DataFrame) -> DataFrame:
    """(host, page, path, text_key, n): elements (no text_key) and texts with their counts in a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        rows: list[tuple] = []
        for batch in batches:
            for host, page, packed in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist(), batch.column("packed")):
                rows.extend(_tokens(host, page, _unpack(unpack.decompress(packed.as_py()))))
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), TOKENS)], schema=TOKENS)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), TOKENS)], schema=TOKENS)

    return carried.select("host", "page", "packed").where("host <> ''").mapInArrow(run, "host string, page long, path string, text_key long, n long")


def surely(support: Column, pages: Column) -> Column:
    """The lower Wilson bound of ``support`` of ``pages``."""
    share = support / pages
    return (share + Z * Z / (2 * pages) - Z * F.sqrt(share * (1 - share) / pages + Z * Z / (4 * pages * pages))) / (1 + Z * Z / pages)


def templates(tokens: DataFrame, host_pages: DataFrame, *, support_share: float = 0.5, min_tokens: int = 3) -> DataFrame:
    """``(host, template_texts)``: the closed texts of each host's template."""
    by_token = (
        tokens.groupBy("host", "path", "text_key", "page")
        .agg(F.max("n").alias("n"))
        .groupBy("host", "path", "text_key")
        .agg(F.count("*").alias("support"), F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).cast("string").alias("vector"))
    )
    by_token = salt(by_token, F.xxhash64("path", "text_key"), SALTS).join(spread(host_pages, SALTS), ["host", "_salt"])
    frequent = cut(by_token.where(surely(F.col("support"), F.col("pages")) >= support_share).select("host", "path", "text_key", "vector"), "tokens")
    classes = frequent.groupBy("host", "vector").agg(F.count("*").alias("members"), F.count_if(F.col("text_key").isNull()).alias("elements"))
    valid = classes.where((F.col("members") >= min_tokens) & (F.col("elements") > 0)).select("host", "vector")
    # a frequent text occurs on half of its host's pages: no more of them than twice the texts of a page
    return frequent.where("text_key is not null").join(valid, ["host", "vector"], "left_semi").groupBy("host").agg(F.collect_set("text_key").alias("template_texts"))


def main_blocks(found: list[Block], template_texts: frozenset[int]) -> list[str]:
    """The texts that fill the page's open slots, in page order."""
    held = [b for b in found if not b.chrome]
    if any(b.article for b in held):
        held = [b for b in held if b.article]
        filled = [b for b in held if not template_texts or _text_key(b.path, b.text) not in template_texts] or held
    else:
        filled = [b for b in held if not template_texts or _text_key(b.path, b.text) not in template_texts]
    if any(b.side for b in filled):
        sizes, links = Counter(), Counter()
        for b in filled:
            sizes[b.side] += len(b.text)
            links[b.side] += b.linked
        whole = sum(sizes.values())
        gone = {s for s in sizes if s and (s.startswith("comments") or 2 * links[s] >= sizes[s] or 2 * sizes[s] <= whole)}
        filled = [b for b in filled if b.side not in gone] or filled
    return [b.text for b in filled]


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support_share: float = 0.5, min_tokens: int = 3, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per page: (page_id, url, text, n_chars)."""
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    carried = cut(parsed(named.withColumn("page", F.xxhash64("html")).select("page_id", "url", "host", "page", "html")), "parsed")
    host_pages = carried.where("host <> ''").select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    found = cut(templates(tokens(carried), host_pages, support_share=support_share, min_tokens=min_tokens), "templates")
    n_keys = found.agg(F.coalesce(F.sum(F.size("template_texts")), F.lit(0))).first()[0]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
        for batch in batches:
            texts = []
            for packed, fixed in zip(batch.column("packed"), batch.column("template_texts").to_pylist()):
                texts.append("\n\n".join(main_blocks(_unpack(unpack.decompress(packed.as_py())), frozenset(fixed or ()))))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    if n_keys <= broadcast_keys:
        joined = carried.join(F.broadcast(found), "host", "left")
    else:
        joined = salt(carried, F.col("page"), SALTS).join(spread(found, SALTS), ["host", "_salt"], "left")
    return joined.select("page_id", "url", "packed", "template_texts").mapInArrow(fill, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
