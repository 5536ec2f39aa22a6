"""Near-duplicate classes by improved consistent weighted sampling (operator 7).

A document is a weighted set of five-word shingles: the weight of a shingle is how often it occurs
times the mean idf of its words, ln(1 + N / df). Improved consistent weighted sampling draws
``samples`` (shingle, level) pairs so that two documents agree in each with a probability equal to
their weighted Jaccard similarity; ``bands`` of them in a row that agree make a candidate. Candidates
are verified exactly on their whole texts, and linked classes are closed under links.

* idf: document frequencies of all words over all documents, in 2^18 hashed counters, which is the
  proven size of what is broadcast.
* Texts with the same words fall into one by a digest before anything else; copies are never paired.
* A bucket of up to ``small_bucket`` documents is paired fully. In a larger one every document is
  first verified against the bucket's smallest; documents that this leaves in another class then meet
  every document of the bucket that is not in their class. No pair that could join two classes is left
  out, and a bucket of copies costs one pair per document.
  Unlike documents of a large bucket meet in blocks, by sketches: the shingles' hashes cut to cells, with
  their weights and counts. The weight of one document in cells that the other has, as a matrix product, is
  at least the weight they share, so only pairs are made that this bound, from either side, lets reach
  ``threshold``. Texts of such a bucket are read once for their sketches, not once for each pair.
* A text that many pairs need, on either side, is salted by its number of pairs; rows of a digest or a
  bucket that a third of all rows share are salted in every join with it, or its few keys are broadcast.

A pair is linked if its weighted Jaccard similarity, from which the samples come, is at least
``threshold``, or if its plain one is (of the multisets, all weights 1): the copies with a few rare words
changed, which idf pulls below the threshold, are near-copies by the plain measure. ``link_by`` names the
measures; either way what the bands propose is decided on whole texts.

With 64 samples in 16 bands a pair at 0.8 is missed with a probability of 2e-4, above that with less.

Nulls and odd cases: a null text is an empty one; a text without words is only equal to texts with
the same characters; a text of fewer than five words is one shingle; documents with a null id are
classes of their own with a null class; rows that repeat an id are versions of one document: each
gets a row, all fall into one class, and candidates are verified on the smallest of their texts; a class's
tie goes to the smallest id; long texts are sampled in pieces, short ones together; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, components, cut, free_memory, if_small, in_bitmap, key_bitmap, packed, salted_join, table
from .shingles import _MIX, _STEP, mix64, shingles_of, words_by_text

COUNTERS = 1 << 18
PIECE = 2048
TOGETHER = 8192  # shingles of short documents that are sampled together
LIKELY = 5.0  # the least a is above that, over the sum of the weights, once in exp(5) times
PAIRS_PER_TEXT = 2048
BATCH = "4m"  # of texts in a Python worker
BLOCK_ROWS = 1024
BLOCK_BYTES = 4 << 20
CELLS = 1 << 16  # of a sketch at most; beyond that the bound is wider, never lower
DENSE = 1 << 20  # cells of all documents of a matrix
ROUNDING = 1e-3  # what single precision may take off a bound


class Sampler:
    """Draws the consistent weighted samples; every (shingle, sample) has variates of its own, from its hash."""

    def __init__(self, samples: int, bands: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.samples, self.bands = samples, bands
        self.odd = rng.integers(1 << 62, dtype=np.uint64, size=samples) * np.uint64(2) + np.uint64(1)

    @staticmethod
    def bits(keys: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The random bits behind r and behind c."""
        first = keys * odd
        high = first >> np.uint64(32)
        first ^= high
        first *= _STEP
        np.right_shift(first, np.uint64(29), out=high)
        first ^= high
        second = first * _MIX
        np.right_shift(second, np.uint64(32), out=high)
        second ^= high
        return first, second

    @staticmethod
    def scores(first: np.ndarray, second: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ln a, level) of elements with these bits and log weights: r ~ Gamma(2, 1), c ~ Gamma(2, 1) and beta ~ Uniform(0, 1)."""

        def gamma(bits: np.ndarray) -> np.ndarray:
            halves = bits.view(np.uint32).astype(np.float32)
            halves += np.float32(0.5)
            product = halves[0::2] * halves[1::2]
            product *= np.float32(2.0**-64)
            return np.maximum(-np.log(product), np.float32(1e-7))

        r, log_c = gamma(first), np.log(gamma(second))
        beta = ((second * _STEP) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        level = np.floor(logs / r + beta)
        return log_c - r * (level - beta) - r, level

    @staticmethod
    def bounds(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """What a times the weight is never below, but for rounding, in units of 2^-64: a >= c exp(-r) / weight, and as both
        Gammas are minus the log of a product of uniforms, exp(-r) is the one product and c at least 1 minus the other."""
        halves = second.view(np.uint32).astype(np.float32)
        low = halves[:, 0::2] * halves[:, 1::2]
        low *= np.float32(-(2.0**-64))
        low += np.float32(1)
        halves = first.view(np.uint32).astype(np.float32)
        low *= halves[:, 0::2]
        low *= halves[:, 1::2]
        return low

    def draw(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The band hashes of a set of ascending distinct keys with positive weights."""
        return self.draw_all([(keys, weights)])[0]

    def draw_all(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The band hashes of sets, a row for each.

        A sample is the element of the least a, which is exponential with the sum of the set's weights as its rate. Where that is
        at most ``LIKELY`` / sum, only elements whose bound is have to be looked at; the a of all are computed for the other samples."""
        n, ends = self.samples, np.cumsum([len(k) for k, _ in sets])
        begins = np.concatenate(([0], ends[:-1]))
        keys, weights = (np.concatenate(x) for x in zip(*sets))
        of = np.repeat(np.arange(len(sets)), ends - begins)
        logs = np.log(weights).astype(np.float32)
        limit = LIKELY / np.bincount(of, weights, len(sets))
        reach = (weights * limit[of] * ((1 + ROUNDING) * 2.0**64)).astype(np.float32)[:, None]
        best = np.full(len(sets) * n, np.inf, dtype=np.float32)
        chosen = np.zeros(len(sets) * n, dtype=np.uint64)

        def keep(row: np.ndarray, column: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
            slot = of[row] * n + column
            score, level = self.scores(first, second, logs[row])
            before = best[slot]
            np.minimum.at(best, slot, score)
            won = np.flatnonzero((score == best[slot]) & (score < before))[::-1]  # of equal ones the first, written last
            chosen[slot[won]] = mix64(keys[row[won]] ^ (level[won].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

        for at in range(0, len(keys), PIECE):
            first, second = self.bits(keys[at : at + PIECE, None], self.odd[None, :])
            place = np.flatnonzero(self.bounds(first, second) <= reach[at : at + PIECE])
            keep(at + place // n, place % n, first.reshape(-1)[place], second.reshape(-1)[place])
        left = np.flatnonzero(~(best <= np.repeat(np.log(limit), n)))
        for at in range(0, len(keys) if len(left) else 0, PIECE):
            low, high = np.maximum(begins[left // n], at), np.minimum(ends[left // n], at + PIECE)
            there = np.maximum(high - low, 0)
            row = np.arange(there.sum()) + np.repeat(low - np.cumsum(there) + there, there)
            column = np.repeat(left % n, there)
            keep(row, column, *self.bits(keys[row], self.odd[column]))
        width = n // self.bands
        chosen = chosen.reshape(len(sets), self.bands, width)
        total = np.zeros((len(sets), self.bands), dtype=np.uint64)
        for i in range(width):
            total = mix64(total * np.uint64(31) + chosen[:, :, i])
        return total


def weighted(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles ascending, weights, counts) of a text's words."""
    shingles = shingles_of(words)
    if not len(shingles):
        return shingles, np.zeros(0), np.zeros(0)
    n = len(words) - len(shingles) + 1
    of_word = idf[(words & np.uint64(COUNTERS - 1)).astype(np.int64)]
    total = np.concatenate(([0.0], np.cumsum(of_word)))
    mean = (total[n:] - total[:-n]) / n
    keys, first, counts = np.unique(shingles, return_index=True, return_counts=True)
    return keys, mean[first] * counts, counts.astype(np.float64)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum(min) / sum(max) of two weighted sets with ascending keys."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low)) if len(both) else 0.0


def word_idf(docs: DataFrame) -> np.ndarray:
    """ln(1 + N / df) for each hashed word counter, over all of ``docs(text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        n = 0
        for batch in batches:
            n += batch.num_rows
            for words in words_by_text(batch.column("text")):
                counts[np.unique((words & np.uint64(COUNTERS - 1)).astype(np.int64))] += 1
        at = np.flatnonzero(counts)
        free_memory()
        schema = pa.schema([("counter", pa.int32()), ("n", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[at], n))], schema=schema)

    rows = docs.select("text").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS + 1 rows
    at, n = rows["counter"].to_numpy(), rows["n"].to_numpy()
    total = int(n[at == -1].sum())
    frequency = np.ones(COUNTERS, dtype=np.float64)
    frequency[at[at >= 0]] = n[at >= 0]
    return np.log1p(max(total, 1) / frequency)


def signatures(docs: DataFrame, idf, samples: int, bands: int) -> DataFrame:
    """``(id, same, bands)`` of ``docs(id, text)``: the digest of the words and the band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, table = Sampler(samples, bands), idf.value
        schema = pa.schema([("id", pa.int64()), ("same", pa.binary()), ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            same, found, sets, held = [], [None] * batch.num_rows, {}, 0
            texts = batch.column("text")
            for i, words in enumerate(words_by_text(texts)):
                if len(words):
                    same.append(xxhash.xxh3_128_digest(words.tobytes()))
                    keys, weights, _ = weighted(words, table)
                    sets[i] = (keys, weights)
                    held += len(keys)
                else:
                    same.append(xxhash.xxh3_128_digest(texts[i].as_py().encode("utf-8", "surrogatepass"), seed=1))
                if sets and (held >= TOGETHER or i == batch.num_rows - 1):
                    for at, drawn in zip(sets, sampler.draw_all(list(sets.values())).astype(np.int64)):
                        found[at] = drawn
                    sets, held = {}, 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(same, pa.binary()), pa.array(found, pa.list_(pa.int64()))], schema=schema)
        free_memory()

    return docs.mapInArrow(run, "id long, same binary, bands array<long>")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs(id, text)`` of ``ids(id)``, one row per id. A bitmap keeps most other texts out of the shuffle."""
    bitmap = docs.sparkSession.sparkContext.broadcast(key_bitmap(ids, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [i for i, x in enumerate(batch.column("id").to_pylist()) if x is not None and in_bitmap(bitmap.value, str(x))]
            yield batch.take(pa.array(kept, pa.int64()))
        free_memory()

    passed = docs.mapInArrow(run, "id long, text string")
    return cut(passed.join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "texts")


MEASURES = ("weighted", "plain")


def rounded_up(x: np.ndarray) -> np.ndarray:
    """Half-precision numbers that are at least ``x``; infinity beyond their range."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    return np.where(half < x, np.nextafter(half, np.float16(np.inf)), half)


def sketches(texts: DataFrame, idf) -> DataFrame:
    """``(rep, sketch)`` of ``texts(id, text)``: the low half of every shingle's hash, its weight and its count, the two rounded up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        schema = pa.schema([("rep", pa.int64()), ("sketch", pa.binary())])
        for batch in batches:
            found = []
            for words in words_by_text(batch.column("text")):
                keys, weights, counts = weighted(words, table)
                found.append(keys.astype(np.uint32).tobytes() + rounded_up(weights).tobytes() + rounded_up(counts).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], schema=schema)
        free_memory()

    return texts.mapInArrow(run, "rep long, sketch binary")


class Sketch:
    """Sketches of documents of about the same number of shingles, to be met with others at any number of cells."""

    def __init__(self, at: np.ndarray, found: list[bytes]):
        self.at, self.n = at, np.array([len(f) // 8 for f in found])
        self.keys = np.concatenate([np.frombuffer(f, np.uint32, n) for f, n in zip(found, self.n)])
        self.held = [np.concatenate([np.frombuffer(f, np.float16, n, (4 + 2 * k) * n) for f, n in zip(found, self.n)]).astype(np.float64) for k in (0, 1)]
        self.row = np.repeat(np.arange(len(found)), self.n)
        self.sums = [np.bincount(self.row, h, len(found)) for h in self.held]
        self.cells = cells_for(int(self.n.max()))

    def dense(self, cells: int, measures: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which cells each document has, and its weights or counts in them."""
        place = self.row * cells + (self.keys & np.uint32(cells - 1)).astype(np.int64)
        size = (len(self.n), cells)
        has = np.zeros(size, dtype=np.float32)
        has.reshape(-1)[place] = 1
        return has, [np.bincount(place, np.minimum(self.held[k], 1e30), has.size).astype(np.float32).reshape(size) for k in measures]


def cells_for(n: int) -> int:
    return min(CELLS, 1 << max(6, (4 * n - 1).bit_length()))


def in_sketches(found: list[bytes]) -> list[Sketch]:
    """``found`` by number of shingles, in parts that fit ``DENSE``."""
    sizes = np.array([len(f) // 8 for f in found])
    order, parts, first = np.argsort(sizes, kind="stable"), [], 0
    while first < len(order):
        last = first + 1
        while last < len(order) and cells_for(int(sizes[order[last]])) == cells_for(int(sizes[order[first]])) and (last - first + 1) * cells_for(int(sizes[order[first]])) <= DENSE:
            last += 1
        parts.append(Sketch(order[first:last], [found[i] for i in order[first:last]]))
        first = last
    return parts


def may_reach(a: list[bytes], b: list[bytes], threshold: float, link_by: tuple[str, ...] = MEASURES) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``a`` and in ``b`` of all pairs of sketches that may be similar by a measure of ``link_by``."""
    measures = [k for k, name in enumerate(MEASURES) if name in link_by]
    left, right = [], []
    others = in_sketches(b)
    for x in in_sketches(a):
        for y in others:
            least, whole = threshold - ROUNDING, [np.add.outer(x.sums[k], y.sums[k]) for k in measures]
            # a sum beyond half precision bounds nothing; else the smaller one must be ``threshold`` of the larger
            if not any((~np.isfinite(w) | (np.minimum.outer(x.sums[k], y.sums[k]) * (1 + least) >= least * w)).any() for k, w in zip(measures, whole)):
                continue
            cells = max(x.cells, y.cells)
            (has_x, of_x), (has_y, of_y) = x.dense(cells, measures), y.dense(cells, measures)
            fits = np.zeros((len(x.n), len(y.n)), dtype=bool)
            for x_in, y_in, w in zip(of_x, of_y, whole):
                common = np.minimum(x_in @ has_y.T, has_x @ y_in.T).astype(np.float64)
                fits |= ~np.isfinite(w) | (common * (1 + least) >= least * w)  # common / (w - common) >= least
            i, j = np.nonzero(fits)
            left.append(x.at[i])
            right.append(y.at[j])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def met_in_blocks(placed: DataFrame, found: DataFrame, threshold: float, link_by: tuple[str, ...]) -> DataFrame:
    """``(a, b)`` of ``placed(bucket, rep, component, hub, hub_component)``: what is not in the class of the bucket's hub, with all of
    the bucket in yet another class, where the sketches ``found(rep, sketch)`` let them be similar. Blocks bound every group."""

    def run(table: pa.Table) -> pa.Table:
        is_a = table.column("is_a").to_numpy()
        a, b = table.filter(pa.array(is_a)), table.filter(pa.array(~is_a))
        i, j = may_reach(a.column("sketch").to_pylist(), b.column("sketch").to_pylist(), threshold, link_by) if a.num_rows and b.num_rows else (np.zeros(0, dtype=np.int64),) * 2
        of = lambda t, name, at: t.column(name).to_numpy()[at]
        # two documents of the rest meet from both sides: one is enough
        new = (of(a, "component", i) != of(b, "component", j)) & ~(of(b, "rest", j) & (of(a, "rep", i) > of(b, "rep", j)))
        return pa.table({"a": pa.array(of(a, "rep", i)[new], pa.int64()), "b": pa.array(of(b, "rep", j)[new], pa.int64())})

    rows = placed.withColumn("rest", F.col("component") != F.col("hub_component")).join(found, "rep").withColumn("bytes", F.octet_length("sketch"))
    rows = cut(rows.select("bucket", "rep", "component", "hub", "rest", "bytes", "sketch"), "sketched")
    blocks = lambda of: F.ceil(F.greatest(F.sum(of.cast("long")) / BLOCK_ROWS, F.sum(F.when(of, F.col("bytes"))) / BLOCK_BYTES)).cast("int")
    sizes = rows.groupBy("bucket").agg(blocks(F.col("rest")).alias("n_a"), blocks(F.col("rep") != F.col("hub")).alias("n_b")).where("n_a > 0 and n_b > 0")
    rows = salted_join(rows, cut(sizes, "blocks"), "bucket", F.col("rep"))
    spread_over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block_of = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    of_a = rows.where("rest").withColumn("is_a", F.lit(True)).withColumn("block_a", block_of("n_a")).withColumn("block_b", spread_over("n_b"))
    of_b = rows.where("rep <> hub").withColumn("is_a", F.lit(False)).withColumn("block_b", block_of("n_b")).withColumn("block_a", spread_over("n_a"))
    both = of_a.unionByName(of_b).select("bucket", "block_a", "block_b", "is_a", "rep", "component", "rest", "sketch")
    return both.groupBy("bucket", "block_a", "block_b").applyInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, idf, threshold: float, link_by: tuple[str, ...]) -> DataFrame:
    """Those of ``pairs(a, b, parts_a, parts_b)`` whose whole texts are similar enough."""
    weighed, plain = "weighted" in link_by, "plain" in link_by

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            keep = []
            left = right = last = None
            for i, (a, x, y) in enumerate(zip(batch.column("a").to_pylist(), words_by_text(batch.column("text_a")), words_by_text(batch.column("text_b")))):
                if a != last:
                    left, last = weighted(x, table), a
                right = weighted(y, table)
                if (weighed and jaccard((left[0], left[1]), (right[0], right[1])) >= threshold) or (plain and jaccard((left[0], left[2]), (right[0], right[2])) >= threshold):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        free_memory()

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = texts_of(docs, ids)
    # a text is copied once for each PAIRS_PER_TEXT pairs that need it, so no task gets all of a hub's
    joined = pairs
    for side, other in (("b", "a"), ("a", "b")):
        joined = joined.withColumn("part", F.pmod(F.xxhash64(other), F.col(f"parts_{side}")).cast("int"))
        needed = pairs.select(side, F.pmod(F.xxhash64(other), F.col(f"parts_{side}")).cast("int").alias("part")).distinct()
        needed = needed.join(texts.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}")), side)
        joined = joined.join(needed, [side, "part"]).drop("part", f"parts_{side}")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    samples: int = 64,
    bands: int = 16,
    small_bucket: int = 12,
    link_by: tuple[str, ...] = MEASURES,
) -> DataFrame:
    """``(doc_id, class_id, kept)``, a row per document: the smallest id of its class, and whether it is that."""
    with arrow_batches(docs.sparkSession, BATCH):
        return _classes(docs, id_col, text_col, threshold, samples, bands, small_bucket, link_by)


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, samples: int, bands: int, small_bucket: int, link_by: tuple[str, ...]) -> DataFrame:
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    idf = docs.sparkSession.sparkContext.broadcast(word_idf(plain))
    signed = cut(signatures(plain, idf, samples, bands), "signed")
    copies = cut(signed.where("id is not null").groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "copies")
    # what only one row has is its own representative; the others meet theirs
    shared = copies.where("copies > 1").select("same", "rep")
    with_rep = cut(salted_join(signed, shared, "same", F.monotonically_increasing_id(), "left").withColumn("rep", F.when(F.col("id").isNotNull() | F.col("rep").isNotNull(), F.coalesce("rep", "id"))), "represented")
    # a row with a null id has no class, but may be a copy of texts with one; of a representative's rows, one with its digest carries the bands
    unique = with_rep.where("id = rep and bands is not null").groupBy("rep", "same").agg(F.first("bands").alias("bands"))

    members = unique.select("rep", F.posexplode("bands").alias("band", "key")).select("rep", F.xxhash64("band", "key").alias("bucket")).distinct()
    sizes = cut(members.groupBy("bucket").agg(F.count("*").alias("in_bucket"), F.min("rep").alias("hub")).where("in_bucket > 1"), "sizes")
    members = cut(salted_join(members, sizes, "bucket", F.col("rep")), "buckets")

    def parts(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        for side, other in (("a", "b"), ("b", "a")):
            load = pairs.groupBy(side).agg(F.ceil(F.count("*") / PAIRS_PER_TEXT).cast("int").alias(f"parts_{side}"))
            busy = load.where(f"parts_{side} > 1")
            pairs = salted_join(pairs, busy, side, F.col(other), "left", few=True).withColumn(f"parts_{side}", F.coalesce(f"parts_{side}", F.lit(1)))
        return pairs

    few = members.where(F.col("in_bucket") <= small_bucket)
    paired = few.select("bucket", F.col("rep").alias("a")).join(few.select("bucket", F.col("rep").alias("b")), "bucket").where("a < b").select("a", "b")
    stars = members.where(F.col("in_bucket") > small_bucket).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    links = cut(verified(parts(paired.unionByName(stars)), plain, idf, threshold, link_by), "links")

    many = members.where(F.col("in_bucket") > small_bucket)
    if not many.isEmpty():
        found = components(links)
        placed = many.select("bucket", "rep", "hub").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        placed = cut(placed, "placed")
        # only buckets that still hold different classes
        hubs = placed.groupBy("bucket").agg(F.max(F.when(F.col("rep") == F.col("hub"), F.col("component"))).alias("hub_component"), F.min("component").alias("_low"), F.max("component").alias("_high"))
        hubs = cut(hubs.where("_low < _high").select("bucket", "hub_component"), "hubs")
        placed = cut(salted_join(placed, hubs, "bucket", F.col("rep")), "placed")
        texts = texts_of(plain, placed.select(F.col("rep").alias("id")).distinct())
        met = met_in_blocks(placed, cut(sketches(texts, idf), "sketches"), threshold, link_by)
        links = cut(links.unionByName(verified(parts(met), plain, idf, threshold, link_by)), "links")
    found = components(links)
    # a repeated id ties all of its texts to one class
    ties = with_rep.where("id is not null and rep <> id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    repeated = ties.join(with_rep.where("id = rep").select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    if not repeated.isEmpty():
        found = components(links.unionByName(repeated))
    found = cut(found.withColumnRenamed("id", "rep"), "classes")
    classes = salted_join(with_rep.select("id", "rep"), found, "rep", F.col("id"), "left")
    classes = classes.withColumn("class_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep")))
    return classes.select(F.col("id").alias("doc_id"), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class; of rows that repeat its id, one with the smallest text."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = cut(found.where("not kept").select(F.col("doc_id").alias("_id")).distinct(), "dropped")
    keyed = packed(docs, id=F.col(id_col), text=F.col(text_col))
    left = keyed.join(if_small(gone), F.col("id") == F.col("_id"), "left_anti")
    again = cut(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id")), "repeated")
    if again.isEmpty():
        return left.select("_row.*")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.col("text").asc_nulls_first(), F.xxhash64("_row")))
    one = left.join(again, F.col("id") == F.col("_id"), "left_semi").withColumn("nth", nth).where("nth = 1").drop("nth")
    return left.join(again, F.col("id") == F.col("_id"), "left_anti").unionByName(one).select("_row.*")


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
