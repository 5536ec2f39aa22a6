"""Benchmark decontamination by SimHash windows (operator 4, native).

Item-sized windows of a document have 64-bit SimHashes of their words. The items' fingerprints are
kept in a multi-index: the 64 bits are cut into ``BLOCKS`` blocks, and each item is filed, beside its
size, under every value of a block that is within ``RADIUS // BLOCKS`` bits of its own. By the
pigeonhole principle two fingerprints within ``RADIUS`` bits agree that closely in at least one block,
so all of them are found; the Hamming distance drops the others. What is left is verified exactly: the
weighted Jaccard similarity of the five-word shingles (a shingle's weight is its count) of window and
item must reach ``threshold``.

Which windows are fingerprinted is decided without loss, wherever the edits are: a window that is
``threshold`` similar to an item of n shingles (counted with repeats) lacks at most ``(1 - threshold) n``
of them, so it holds at least one of any ``floor((1 - threshold) n) + 1`` different ones (or of all, if
there are fewer). That many, the longest, are the item's anchors, and every item-sized window that
holds an anchor, at any offset, is fingerprinted: n windows a hit, for hits that unrelated text hardly
ever has. What can be lost is a window beyond ``RADIUS`` bits; ``tests/llm`` measures it under edits at
edges, insertions, deletions, replacements and moved halves: none.

With a benchmark of at most ``BROADCAST_BYTES`` of text one pass over the documents explodes words,
hashes the shingle at each and probes the broadcast anchors; only the different windows of a document
are shuffled, no texts. With a larger one the first pass shuffles (document, position, shingle hash)
alone, joined with the anchors, and a second takes the windows of the documents that were hit.

Nulls and odd cases: null texts have no words; an item of no words is skipped, one of fewer than
five words is one shingle; a null item id is kept as a null id; repeated rows are judged each, ties of
an item's windows count once; a long text costs in proportion to its words; an
empty document table gives an empty result, an empty benchmark leaves every document clean; other
columns are ignored. Words are runs of letters and digits of the lower-cased text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, if_small, packed, table

SHINGLE = 5
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
BROADCAST_BYTES = 32 << 20


def split_words(text: Column) -> Column:
    """The lower-cased words in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(tokens: Column) -> Column:
    n = F.least(F.size(tokens), F.lit(SHINGLE))
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    return F.when(F.size(tokens) > 0, F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, n), " "))))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where lambdas read it."""
    return F.transform(F.array(value), use)[0]


def simhash(tokens: Column) -> Column:
    """Bit b is set if it is set in more than half of the words' hashes."""
    return let(F.transform(tokens, lambda w: F.xxhash64(w)), _majority)


def _majority(hashes: Column) -> Column:
    one = F.lit(1).cast("long")
    set_in = lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("getbit", h, b).cast("int"))
    bit = lambda b: F.when(set_in(b) * 2 > F.size(hashes), F.call_function("shiftleft", one, b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def block_of(fingerprint: Column, block: Column) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, (block * BLOCK_BITS).cast("int")).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long"))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """sum of the smaller over sum of the larger counts of two bags; null if both are empty."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    low = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return let(low, lambda n: F.try_divide(n.cast("double"), (F.size(a) + F.size(b) - n).cast("double")))


def shingle_at(tokens: Column, pos: Column, width: Column) -> Column:
    """The hash of the ``width`` words from ``pos`` (from 0) on."""
    return F.xxhash64(F.slice(tokens, pos + 1, width))


def prepare(benchmark: DataFrame, item_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``anchors(key, width, n)`` and ``index(n, block, value, item_id, fingerprint, item_shingles)``."""
    items = benchmark.select(F.col(item_col).alias("item_id"), split_words(F.col(text_col)).alias("tokens")).where("size(tokens) > 0").withColumn("n", F.size("tokens"))
    items = items.withColumn("width", F.least("n", F.lit(SHINGLE)))
    # n words have n - width + 1 shingles; 1e-9 is for what the product may lack by rounding
    wanted = F.floor((F.col("n") - F.col("width") + 1) * (1 - threshold) + 1e-9).cast("int") + 1
    starts = F.sequence(F.lit(0), F.col("n") - F.col("width"))
    each = F.transform(starts, lambda i: F.slice("tokens", i + 1, F.col("width")))
    ordered = F.array_sort(F.transform(F.array_distinct(each), lambda s: F.struct((-F.length(F.array_join(s, " "))).alias("short"), s.alias("words"))))
    anchors = items.select("n", "width", F.explode(F.slice(ordered, F.lit(1), wanted)["words"]).alias("words")).select(F.xxhash64("words").alias("key"), "width", "n").distinct()
    prints = items.select("n", "item_id", simhash(F.col("tokens")).alias("fingerprint"), shingles(F.col("tokens")).alias("item_shingles"))
    masks = [m for m in range(1 << BLOCK_BITS) if bin(m).count("1") <= RADIUS // BLOCKS]
    index = prints.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))))
    return anchors, index.select("n", "block", block_of(F.col("fingerprint"), F.col("block")).bitwiseXOR(F.col("mask")).alias("value"), "item_id", "fingerprint", "item_shingles")


def windows_around(hits: DataFrame) -> DataFrame:
    """``hits(doc_id, text_key, tokens, pos, width, n)`` -> the different ``(doc_id, text_key, n, window)`` that hold them."""
    last = F.greatest(F.size("tokens") - F.col("n"), F.lit(0))
    start = F.least(F.greatest(F.col("pos") + F.col("width") - F.col("n"), F.lit(0)), last)
    spread_out = hits.withColumn("start", F.explode(F.sequence(start, F.greatest(start, F.least("pos", last)))))
    return spread_out.select("doc_id", "text_key", "n", F.array_join(F.slice("tokens", F.col("start") + 1, "n"), " ").alias("window")).distinct()


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.8,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(doc_id, text_key, item_id, similarity)``: each item that a document holds, at its most similar window."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text_col)), F.lit(0))).first()[0]
    small = size <= broadcast_bytes
    hint = F.broadcast if small else (lambda df: df)
    anchors, index = (cut(df, "benchmark") for df in prepare(benchmark, item_col, item_text_col, threshold))
    widths = sorted(r["width"] for r in anchors.select("width").distinct().collect())  # SHINGLE numbers at most
    text = F.col(text_col)
    tokens = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), split_words(text).alias("tokens"))

    def probed(width: int, *carried: str) -> DataFrame:
        # the explode and the probe are one generated loop
        rows = tokens.select("doc_id", "text_key", "tokens", F.posexplode_outer("tokens").alias("pos", "word"))
        rows = rows.select("doc_id", "text_key", *carried, "pos", shingle_at(F.col("tokens"), F.col("pos"), F.lit(width)).alias("key"))
        return rows.join(hint(anchors.where(F.col("width") == width)), "key").drop("key")

    hits = None
    for width in widths:
        found = probed(width, "tokens") if small else probed(width)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return tokens.limit(0).select("doc_id", "text_key", F.lit(None).cast(index.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("double").alias("similarity"))
    if not small:
        # a document's hits are at most its words times the item sizes, and its text is joined once, not once a hit
        spots = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("pos", "width", "n")).alias("spots"))
        hit_by = spots.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spots")
        joined = tokens.join(hit_by, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
        hits = joined.select("doc_id", "text_key", "tokens", F.explode("spots").alias("spot")).select("doc_id", "text_key", "tokens", "spot.*")
    windows = cut(windows_around(hits), "windows")
    windows = windows.select("doc_id", "text_key", "n", F.split("window", " ").alias("window"))
    windows = windows.select("doc_id", "text_key", "n", simhash(F.col("window")).alias("own"), shingles(F.col("window")).alias("shingles"))
    blocks = windows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("value", block_of(F.col("own"), F.col("block")))
    differ = F.col("own").bitwiseXOR(F.col("fingerprint"))
    first = F.lit(None).cast("int")
    for b in reversed(range(BLOCKS)):
        first = F.when(F.bit_count(block_of(differ, F.lit(b))) <= RADIUS // BLOCKS, b).otherwise(first)
    near = blocks.join(hint(index), ["n", "block", "value"]).where((F.bit_count(differ) <= RADIUS) & (F.col("block") == first))
    scored = near.select("doc_id", "text_key", "item_id", weighted_jaccard(F.col("item_shingles"), F.col("shingles")).alias("similarity")).where(F.col("similarity") >= threshold)
    return scored.groupBy("doc_id", "text_key", "item_id").agg(F.max("similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    found = cut(leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "leaks")
    keyed = packed(docs, id=F.col(id_col), key=F.xxhash64(text_col))
    return keyed.join(if_small(found), F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_anti").select("_row.*")


def op4_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))
