"""Quality classifier by interpolated modified Kneser-Ney models of trusted text (operator 5).

The n-grams are of five characters (see ``kn_model``), counted over all labelled text. Counts are
sharded by n-gram and joined order by order: each order's counts with their context's totals, and with
the probabilities of the order below, which come from continuation counts. What comes out, the ln P of
every n-gram seen and the weight that every context leaves to the order below, grows with the corpus
and is written in ``shards`` by the character before the last, so that all that one position of a text
looks up lies in one shard. Documents are joined with the shards one by one (a shard's size is bounded
by ``SHARD_ROWS``, and is the build side of a hash join), and the partial sums of a document add up to
its perplexity over its whole text. No text is shuffled for it.

Trusted are documents whose labels all say quality 1 and toxic 0; bad ones have a label of quality 0
or toxic 1. Each is fitted in two halves, and every document is compared with the models of the halves
that it does not belong to; so all trusted documents are held out, and all of them set the thresholds:

* score: the mean -ln P under the trusted model, for short texts drawn towards the language's median as
  if ``prior_chars`` more characters had that mean; up to ``odd_chars`` characters of more than ``ODD`` nats (a
  name, an address, a password in a clean text) are left out of the mean;
* lean: by how much characters are likelier in bad text than in trusted text, as far as that exceeds
  1 nat; summed, less the language's mean, over its standard deviation for a text of n characters, as the
  root of n + ``prior_chars`` + n^2 / ``even_chars``: chance evens out along a text, a text's own style does not.

A document goes if one of them lies above the language's quantile of level ``1 - tail`` of trusted
documents. Beyond the ninth decile the quantile follows the exponential tail fitted to what exceeds it
(peaks over threshold), so a few documents give one too. A language's centre and spread are weighed
n : ``prior_docs`` against those of all languages, n being its trusted documents; there is no step at
which a language starts to count. A document without a language has n = 0.

With no trusted or no bad text in one of the halves that score says nothing, and documents stay.

Nulls and odd cases: a null text is an empty one, and kept; null ids have no label; rows that repeat
an id are judged each; equal rows get equal results; a score equal to its threshold is kept; a long
text is read in pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, held_by_worker, if_small, packed, spread, table
from .kn_model import ORDER, Model, Table, different, discounts, gram_keys, slices, strings

SALTS = 8
SHARD_ROWS = 5_000_000  # of 12 bytes
ODD = 3.0
GOOD, BAD = 0, 2  # the models of the first halves; the second halves' follow


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return good.where("quality = 1 and toxic = 0").select(F.col("doc_id").cast("long").alias("id"))


def bad_ids(labels: DataFrame) -> DataFrame:
    bad = labels.where("doc_id is not null and (quality < 1 or toxic > 0)")
    return bad.select(F.col("doc_id").cast("long").alias("id")).distinct()


def half_of(column: str) -> Column:
    """Which half an id belongs to; a null id goes with the first."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(column), F.lit("half")), F.lit(2)), F.lit(0)).cast("int")


def count_grams(texts: DataFrame) -> DataFrame:
    """``(model, gram, n)`` over all of ``texts(model, text)``; a task holds the different n-grams of one slice."""
    schema = pa.schema([("model", pa.int32()), ("gram", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = batch.column("model").to_numpy(zero_copy_only=False)
            texts = batch.column("text")
            for model in np.unique(models):
                for line, _, places in slices(texts[i].as_py() for i in np.flatnonzero(models == model).tolist()):
                    first, codes = different(line, places)
                    counts = np.bincount(codes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), model, dtype=np.int32)), pa.array(strings(line, first), pa.string()), pa.array(counts)], schema=schema)

    return texts.select("model", "text").mapInArrow(run, "model int, gram string, n long").groupBy("model", "gram").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame) -> DataFrame:
    """``(model, k, gram, p)`` and, with the context as gram and ``is_left``, the weight it leaves to the order below."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different characters come before
        levels[k] = levels[k + 1].groupBy("model", F.expr(f"right(gram, {k})").alias("gram")).agg(F.count("*").alias("n"))
    lower, found = None, None
    for k in range(1, ORDER + 1):
        level = cut(levels[k], "order")
        of = level.groupBy("model").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)), F.count("*").alias("types")).collect()  # a row per model
        d = {r["model"]: discounts(*(r[f"n{i}"] for i in range(1, 5))) for r in of}
        by_model = lambda i: F.coalesce(*(F.when(F.col("model") == m, F.lit(x[i])) for m, x in d.items()), F.lit(0.5))  # noqa: E731, B023
        taken = F.when(F.col("n") == 1, by_model(0)).when(F.col("n") == 2, by_model(1)).otherwise(by_model(2))
        context = F.expr(f"left(gram, {k - 1})")
        totals = level.groupBy("model", context.alias("context")).agg(F.sum("n").alias("total"), F.sum(taken).alias("kept"))
        totals = totals.select("model", "context", "total", (F.col("kept") / F.col("total")).alias("left_over"))
        joined = level.withColumn("context", context).withColumn("tail", F.expr(f"right(gram, {k - 1})")).join(totals, ["model", "context"])
        if lower is None:
            types = {r["model"]: r["types"] for r in of}
            joined = joined.withColumn("below", F.coalesce(*(F.when(F.col("model") == m, F.lit(1.0 / (n + 1))) for m, n in types.items()), F.lit(1.0)))
        else:
            joined = joined.join(lower, ["model", "tail"])
        p = (F.col("n") - taken) / F.col("total") + F.col("left_over") * F.col("below")
        level = cut(joined.select("model", "gram", p.alias("p")), "order")
        lower = level.select("model", F.col("gram").alias("tail"), F.col("p").alias("below"))
        rows = level.select("model", F.lit(k).alias("k"), "gram", "p", F.lit(False).alias("is_left")).unionByName(
            totals.select("model", F.lit(k).alias("k"), F.col("context").alias("gram"), F.col("left_over").alias("p"), F.lit(True).alias("is_left"))
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def shard_of(n_shards: int) -> Column:
    """By the character before the one that is looked up; order 1, which has none, goes with every shard (-1)."""
    before = F.when(F.col("is_left"), F.expr("right(gram, 1)")).otherwise(F.expr("substring(gram, k - 1, 1)"))
    return F.when(F.col("k") == 1, -1).otherwise(F.pmod(F.crc32(before.cast("binary")), F.lit(n_shards)).cast("int"))


def _shards_of(line: np.ndarray, n_shards: int) -> np.ndarray:
    import zlib

    unique, codes = np.unique(line, return_inverse=True)
    return np.array([zlib.crc32(chr(c).encode()) % n_shards for c in unique.tolist()], dtype=np.int64)[codes]


def hashed(model: DataFrame) -> DataFrame:
    """The model's rows with a hash in the place of the n-gram, as they are looked up: 12 bytes and their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, left = (np.array(batch.column(c).to_pylist(), dtype=np.int64) for c in ("k", "is_left"))
            grams, found = batch.column("gram"), np.zeros(batch.num_rows, dtype=np.uint64)
            for n in np.unique(k - left).tolist():
                at = np.flatnonzero(k - left == n)
                found[at] = gram_keys(grams.take(pa.array(at)).to_pylist(), n)
            ln_p = np.log(batch.column("p").to_numpy(zero_copy_only=False)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "model", "k", "is_left")), pa.array(found.view(np.int64)), pa.array(ln_p)], names=["shard", "model", "k", "is_left", "hash", "ln_p"])

    return model.select("shard", "model", "k", "is_left", "gram", "p").mapInArrow(run, "shard int, model int, k int, is_left boolean, hash long, ln_p float")


@functools.lru_cache(maxsize=1)
def _loaded(path: str, shard: int) -> dict[int, Model]:
    """The models of one shard, once per Python worker."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    partitions = ds.partitioning(pa.schema([("shard", pa.int32())]), flavor="hive")
    found: dict = {}
    data = ds.dataset(root, filesystem=system, format="parquet", partitioning=partitions)
    for batch in data.to_batches(columns=["model", "k", "is_left", "hash", "ln_p"], filter=ds.field("shard").isin([-1, shard]), batch_size=1 << 16, batch_readahead=1, fragment_readahead=1):
        model, k, left, hashes, ln_p = (batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names)
        part = (model.astype(np.int64) * (ORDER + 1) + k) * 2 + left
        for key in np.unique(part).tolist():
            at = part == key
            found.setdefault(key, []).append((hashes[at].view(np.uint64), ln_p[at]))
        del batch, model, k, left, hashes, ln_p, part
    tables = {}
    for key in list(found):  # one after the other, so that little is held twice
        parts = found.pop(key)
        tables[key] = Table(np.concatenate([h for h, _ in parts]), np.concatenate([p for _, p in parts]))
        del parts
    pa.default_memory_pool().release_unused()
    none = Table(np.zeros(0, dtype=np.uint64), np.zeros(0))
    models = {}
    for model in {key // (2 * (ORDER + 1)) for key in tables}:
        of = lambda k, left: tables.get((model * (ORDER + 1) + k) * 2 + left, none)  # noqa: E731, B023
        orders = range(1, ORDER + 1)
        models[model] = Model([of(k, 0) for k in orders], [of(k, 1) for k in orders], -float(np.log(len(of(1, 0).hashes) + 1)))
    return models


held_by_worker.append(_loaded.cache_clear)

SCORES = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("text_key", pa.int64()), ("half", pa.int32()), ("nll", pa.float64()), ("excess", pa.float64()), ("n", pa.int64()), ("odd", pa.int64()), ("odd_nll", pa.float64())])


def perplexity(docs: DataFrame, model_path: str, n_shards: int) -> DataFrame:
    """``(id, lang, text_key, half, nll, excess, n, odd, odd_nll)`` of ``docs(id, lang, text_key, text)``: over the n characters of the whole
    text and its end the sum of -ln P under the trusted model of the other half, and the sum of what -ln P exceeds that of bad
    text by, beyond 1; and the number and -ln P of characters beyond ODD. With several shards a row is the part of one shard."""

    def scan(shard: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models = _loaded(model_path, shard)
            for batch in batches:
                halves = np.array(batch.column("half").to_pylist(), dtype=np.int64)
                sums, excess, sizes, odd, odd_sums = (np.zeros(batch.num_rows) for _ in range(5))
                for line, owner, places in slices(text.as_py() for text in batch.column("text")):
                    if n_shards > 1:
                        mine = np.flatnonzero(_shards_of(line, n_shards)[places - 1] == shard)
                        owner, places = owner[mine], places[mine]
                    first, codes = different(line, places)
                    good, bad = np.zeros(len(places)), np.zeros(len(places))
                    for half in (0, 1):
                        here = np.flatnonzero(halves[owner] == half)
                        used = np.unique(codes[here])
                        for model, into in ((GOOD + 1 - half, good), (BAD + 1 - half, bad)):
                            if len(used) and model in models:
                                values = np.zeros(len(first))
                                values[used] = models[model].surprise(line, first[used])
                                into[here] = values[codes[here]]
                    sums += np.bincount(owner, good, batch.num_rows)
                    excess += np.bincount(owner, np.maximum(good - bad - 1, 0), batch.num_rows)
                    sizes += np.bincount(owner, minlength=batch.num_rows)
                    strange = good > ODD
                    odd += np.bincount(owner[strange], minlength=batch.num_rows)
                    odd_sums += np.bincount(owner[strange], good[strange], batch.num_rows)
                arrays = [batch.column(c) for c in ("id", "lang", "text_key", "half")] + [pa.array(sums), pa.array(excess), pa.array(sizes.astype(np.int64)), pa.array(odd.astype(np.int64)), pa.array(odd_sums)]
                yield pa.RecordBatch.from_arrays(arrays, schema=SCORES)

        return run

    rows = docs.select("id", "lang", "text_key", half_of("id").alias("half"), "text")
    found = None
    for shard in range(n_shards):
        part = rows.mapInArrow(scan(shard), "id long, lang string, text_key long, half int, nll double, excess double, n long, odd long, odd_nll double")
        found = part if found is None else found.unionByName(part)
    return found


def spread_of(held: DataFrame, column: str, width: float = 0.001) -> DataFrame:
    """``(lang, docs, middle, range)``: median and interquartile range of ``column`` by language, and of all at a null one.

    Values are counted in bins of ``width``, so a group holds its different bins only."""
    bins = held.where("lang is not null").groupBy("lang", F.round(F.col(column) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    every = held.groupBy(F.round(F.col(column) / width).cast("long").alias("bin")).agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n")
    quarters = F.expr("percentile(bin, array(0.25, 0.5, 0.75), n)")
    found = bins.unionByName(every).where("bin is not null").groupBy("lang").agg(F.sum("n").alias("docs"), quarters.alias("q"))
    return found.select("lang", "docs", (F.col("q")[1] * width).alias("middle"), ((F.col("q")[2] - F.col("q")[0]) * width).alias("range"))


class Scale:
    """Centre and spread of a score by language, weighed against those of all."""

    def __init__(self, held: DataFrame, column: str, prior_docs: int):
        found = cut(spread_of(held, column), "spread")
        self.column, self.whole = column, found.where("lang is null").first()
        weigh = lambda c: (F.col("docs") * F.col(c) + F.lit(prior_docs * self.whole[c])) / (F.col("docs") + prior_docs)
        self.by_language = found.limit(0).select("lang", F.col("middle").alias(f"{column}_middle"), F.col("range").alias(f"{column}_range"))
        if self.whole is not None:
            self.by_language = found.where("lang is not null").select("lang", weigh("middle").alias(f"{column}_middle"), weigh("range").alias(f"{column}_range"))

    def middle(self) -> Column:
        return F.coalesce(f"{self.column}_middle", F.lit(None if self.whole is None else self.whole["middle"]).cast("double"))

    def range(self) -> Column:
        return F.greatest(F.coalesce(f"{self.column}_range", F.lit(None if self.whole is None else self.whole["range"]).cast("double")), F.lit(1e-6))


def with_languages(rows: DataFrame, languages: DataFrame) -> DataFrame:
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id", "text_key"), F.lit(SALTS)).cast("int"))
    return salted.join(spread(languages, SALTS), ["lang", "_salt"], "left").drop("_salt")


def tail_quantile(held: DataFrame, z: Column, tail: float) -> float | None:
    """The quantile of level ``1 - tail``: the ninth decile, and the exponential tail fitted to what exceeds it."""
    bins = cut(held.select(F.round(z * 100).cast("long").alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n")), "bins")
    ninth = bins.agg(F.expr("percentile(bin, 0.9, n)").alias("q")).first()["q"]
    if ninth is None:
        return None
    over = bins.where(F.col("bin") > ninth).agg((F.sum((F.col("bin") - ninth) * F.col("n")) / F.sum("n")).alias("mean")).first()["mean"]
    return (ninth + (over or 0.0) * float(np.log(0.1 / tail))) / 100


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    tail: float = 1e-4,
    prior_chars: int = 100,
    even_chars: int = 3_000,
    odd_chars: int = 24,
    prior_docs: int = 20,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per document: (doc_id, lang, text_key, perplexity, score, threshold, lean, lean_threshold, kept)."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("text_key"))
    good = trusted_ids(labels).withColumn("model", half_of("id") + GOOD)
    ids = cut(good.unionByName(bad_ids(labels).withColumn("model", half_of("id") + BAD)), "labelled")
    grams = cut(count_grams(plain.join(if_small(ids), "id")), "grams")
    path = fresh_path(spark, "model")
    model = cut(fit(grams), "model")
    n_shards = max(1, -(-model.count() // shard_rows))
    hashed(model.withColumn("shard", shard_of(n_shards))).repartition("shard").write.partitionBy("shard").parquet(path)
    present = {r["model"] for r in grams.select("model").distinct().collect()}  # four at most
    able, lean_able = {GOOD, GOOD + 1} <= present, {GOOD, GOOD + 1, BAD, BAD + 1} <= present
    if not present:
        scored = plain.select("id", "lang", "text_key", F.lit(0.0).alias("nll"), F.lit(0.0).alias("excess"), F.lit(1).cast("long").alias("n"), F.lit(0).alias("odd"), F.lit(0.0).alias("odd_nll"), (F.col("text") == "").alias("empty"))
    else:
        scored = perplexity(plain, path, n_shards)
        if n_shards > 1:  # equal rows have equal sums: they are added up as one and counted
            scored = scored.groupBy("id", "lang", "text_key").agg(*(F.sum(c).alias(c) for c in ("nll", "excess", "n", "odd", "odd_nll")))
            copies = plain.groupBy("id", "lang", "text_key").agg(F.count("*").alias("copies"))
            same = F.col("id").eqNullSafe(F.col("_id")) & F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("text_key") == F.col("_key"))
            copies = copies.select(F.col("id").alias("_id"), F.col("lang").alias("_lang"), F.col("text_key").alias("_key"), "copies")
            scored = scored.join(copies, same).select("id", "lang", "text_key", *((F.col(c) / F.col("copies")).alias(c) for c in ("nll", "excess", "n", "odd", "odd_nll")), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_")).drop("_")
        scored = scored.select("id", "lang", "text_key", "nll", "excess", "n", "odd", "odd_nll", (F.col("n") == 1).alias("empty"))
    scored = cut(scored.withColumn("mean", F.col("nll") / F.col("n")), "scored")
    trusted = ids.where(F.col("model") < BAD).select("id")
    is_held = lambda rows: rows.join(if_small(trusted), "id", "left_semi")

    means = Scale(is_held(scored), "mean", prior_docs)
    rates = is_held(scored).groupBy("lang").agg(F.sum("excess").alias("e"), F.sum("n").alias("c"), F.count("*").alias("docs"))
    rate = rates.agg(F.sum("e"), F.sum("c"), F.sum("docs")).first()
    usual, chars = (0.0, 0.0) if not rate[1] else (rate[0] / rate[1], rate[1] / rate[2])
    prior = prior_docs * chars  # characters
    rates = rates.where("lang is not null").select("lang", ((F.col("e") + usual * prior) / (F.col("c") + prior)).alias("rate"))
    rows = with_languages(scored, means.by_language.join(rates, "lang", "left"))
    left_out = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(float(odd_chars)), F.col("odd").cast("double")), F.lit(1.0)))
    rows = rows.withColumn("score", (F.col("nll") - F.col("odd_nll") * left_out + means.middle() * prior_chars) / (F.col("n") - F.col("odd") * left_out + prior_chars))
    rows = rows.withColumn("lean", (F.col("excess") - F.coalesce("rate", F.lit(usual)) * F.col("n")) / F.sqrt(F.col("n") + prior_chars + F.col("n") * F.col("n") / even_chars))
    rows = cut(rows.select("id", "lang", "text_key", "mean", "score", "lean", "empty"), "drawn")
    held = cut(is_held(rows), "held")
    limits = {}
    scales = [Scale(held, name, prior_docs) for name in ("score", "lean")]
    both = scales[0].by_language.join(scales[1].by_language, "lang", "left")
    placed, held = with_languages(rows, both), with_languages(held, both)
    for scale, usable in zip(scales, (able, lean_able)):
        high = tail_quantile(held, (F.col(scale.column) - scale.middle()) / scale.range(), tail) if usable else None
        limits[scale.column] = F.lit(None).cast("double") if high is None else scale.middle() + scale.range() * F.lit(high)
    over = F.coalesce(F.col("score") > limits["score"], F.lit(False)) | F.coalesce(F.col("lean") > limits["lean"], F.lit(False))
    return placed.select(
        F.col("id").alias("doc_id"),
        "lang",
        "text_key",
        F.exp("mean").alias("perplexity"),
        "score",
        limits["score"].alias("threshold"),
        "lean",
        limits["lean"].alias("lean_threshold"),
        (F.col("empty") | ~over).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rejected documents."""
    judged = classify(docs, labels, id_col=id_col, text_col=text_col, **options)
    gone = cut(judged.where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "rejected")
    keyed = packed(docs, id=F.col(id_col), key=F.xxhash64(text_col))
    return keyed.join(if_small(gone), F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_anti").select("_row.*")


def op5_quality_kneser_ney(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")
