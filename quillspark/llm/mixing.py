"""Mixing sources to target weights by Sainte-Lague apportionment (operator 10, native).

A source's text is a line of words cut into blocks of equal length. Seats (blocks) go to sources by
the highest quotients ``target / (2k - 1)``, then in each source to its shards in the same way; in
a shard a seeded, evenly spaced selection picks that many blocks. A document takes the words of the
picked blocks that lie in it.

Only (id, source, size) rows are shuffled. Sources and shards are the only things ranked in one
task per group, one row each; documents are ranked inside shards of ``shard_words`` words, so a hot
source is spread over as many tasks as its size asks for.

Nulls and odd cases: a null text has size 0; a null source is a source of its own and comes last;
a null id is ordered first; repeated rows are all mixed, each on its own; an empty table gives an
empty result; if all sizes are 0 every target and every ``taken`` is 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: ``share`` of all words split by weight, a source
    stopping at ``epochs`` times its size and its excess going to the others by weight.

    The level L with sum(least(epochs * size, L * weight)) = share * total solves all the reshare
    rounds at once: in the order of cap / weight, the first source that is not full fixes L."""
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(epochs))
        .withColumn("whole", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("full", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("whole") - F.col("full")) / F.col("left"))
        .withColumn("nth", F.row_number().over(by_cap))
    )
    fixed = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("nth", "level"))
    return ranked.withColumn("fix", F.min(fixed).over(everything)).select(
        "source", "source_size", F.coalesce(F.least("cap", F.col("fix.level") * F.col("weight")), F.col("cap")).alias("target")
    )


def sainte_lague(rows: DataFrame, group: list[str], name: str, share: str, seats: str) -> DataFrame:
    """Adds ``quota``: how many of its group's ``seats`` each row gets by the highest quotients
    ``share / (2k - 1)``, ties to the smaller ``name``.

    With m rows in a group, dividing so that (seats - m/2) come out gives each row no more than its
    quota, (seats + m/2) no less, so only about 4 m quotients have to be ranked."""
    whole = Window.partitionBy(*group)
    bounds = rows.withColumn("_m", F.count("*").over(whole)).withColumn("_t", F.sum(share).over(whole))
    scaled = lambda side: F.when(F.col("_t") > 0, F.col(share) * F.greatest(F.col(seats) + side * F.col("_m") / 2, F.lit(0.0)) / F.col("_t")).otherwise(0.0)
    bounds = (
        bounds.withColumn("_low", F.greatest(F.floor(scaled(-1) + 0.5) - 1, F.lit(0)))
        .withColumn("_high", F.when(F.col(share) > 0, F.floor(scaled(1) + 0.5) + 1).otherwise(0))
        .withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
        .withColumn("_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
        .withColumn("_q", F.col(share) / (2 * F.col("_k") - 1))
    )
    ranked = bounds.withColumn("_n", F.row_number().over(whole.orderBy(F.col("_q").desc_nulls_last(), F.col(name).asc_nulls_last(), "_k")))
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_n") <= F.col("_open")), 1).otherwise(0))
    kept = [c for c in rows.columns]
    return ranked.groupBy(*kept, "_low").agg(won.alias("_won")).select(*kept, (F.col("_low") + F.col("_won")).cast("long").alias("quota"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    epochs: float = 2.0,
    block_words: int = 32,
    shard_words: int = 4_000_000,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken, source, shard, quota, text_key)."""
    code = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), code.alias("code"), F.xxhash64(text_col).alias("text_key")), "sizes")
    wanted = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    wanted = wanted.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    quotas = cut(sainte_lague(wanted, [], "source", "target", "seats").select("source", "source_size", "target", F.col("quota").alias("source_quota")), "quotas")

    shards = F.greatest(F.ceil(F.col("source_size") / F.lit(shard_words)), F.lit(1)).cast("long")
    placed = sized.join(quotas.withColumn("shards", shards), sized["source"].eqNullSafe(quotas["source"])).drop(quotas["source"])
    placed = placed.withColumn("shard", F.pmod(F.conv(F.substring("code", 1, 8), 16, 10).cast("long"), F.col("shards")))
    per_shard = placed.groupBy("source", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    per_shard = sainte_lague(per_shard.withColumn("share", F.col("shard_size").cast("double")), ["source"], "shard", "share", "source_quota")
    per_shard = per_shard.withColumn("blocks", F.ceil(F.col("shard_size") / F.lit(block_words)).cast("long")).select(
        F.col("source").alias("s_source"),
        F.col("shard").alias("s_shard"),
        "blocks",
        F.least(F.col("quota"), F.floor(F.col("blocks") * F.lit(epochs)).cast("long")).alias("quota"),
        F.conv(F.substring(F.md5(F.concat(F.lit(seed + "#"), F.coalesce("source", F.lit("")), F.lit("#"), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long").alias("turn"),
    )
    line = Window.partitionBy("source", "shard").orderBy(F.col("code").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "size")
    lined = placed.withColumn("stop", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    lined = lined.join(per_shard, lined["source"].eqNullSafe(per_shard["s_source"]) & (lined["shard"] == per_shard["s_shard"]), "left")
    passes, rest, start = F.col("passes"), F.col("rest"), F.col("stop") - F.col("size")
    lined = (
        lined.withColumn("passes", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("blocks"))
        .withColumn("turn", F.when(F.col("blocks") > 0, F.pmod("turn", F.greatest("blocks", F.lit(1)))).otherwise(0))
    )

    def picked(block: Column) -> Column:
        """How many of the first ``block`` blocks are picked: floor steps of rest / blocks, turned by a seed."""
        step = lambda x: F.floor(((x + F.col("turn")) * rest).cast("double") / F.greatest("blocks", F.lit(1)))
        return step(block) - step(F.lit(0))

    def words(at: Column) -> Column:
        block = F.floor(at / F.lit(block_words))
        return F.lit(block_words) * picked(block) + (at - block * block_words) * (picked(block + 1) - picked(block))

    taken = F.when(F.col("size") > 0, passes * F.col("size") + words(F.col("stop")) - words(start)).otherwise(0)
    return lined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "shard", "quota", "text_key")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that the mix takes words of, with ``size``, ``source_size``, ``target`` and ``taken``,
    which replace columns of these names. Of rows equal in id and text each gets the most that one of them has."""
    found = mix(docs, id_col=id_col, text_col=text_col, **options).where("taken > 0")
    one = ["size", "source_size", "target"]
    found = cut(found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(*(F.first(c).alias(c) for c in one), F.max("taken").alias("taken")), "mix")
    keyed = packed(docs.drop(*one, "taken"), id=F.col(id_col), key=F.xxhash64(text_col))
    return keyed.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("_row.*", *one, "taken")


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _rank_seats(rows: str, group: str, name: str, share: str, seats: str, keep: str) -> str:
    over = f"PARTITION BY {group}" if group else ""
    scaled = lambda sign: f"CASE WHEN t_ > 0 THEN {share} * greatest({seats} {sign} m_ / 2.0::DOUBLE, 0.0) / t_ ELSE 0.0 END"
    return f"""
      SELECT {keep}, (low_ + sum(CASE WHEN k_ IS NOT NULL AND n_ <= open_ THEN 1 ELSE 0 END))::BIGINT AS quota FROM (
        SELECT *, row_number() OVER ({over} ORDER BY {share} / (2 * k_ - 1)::DOUBLE DESC NULLS LAST, {name} ASC NULLS LAST, k_) AS n_ FROM (
          SELECT *, unnest(CASE WHEN high_ > low_ THEN generate_series(low_ + 1, high_) ELSE [NULL::BIGINT] END) AS k_ FROM (
            SELECT *, {seats} - sum(low_) OVER ({over}) AS open_ FROM (
              SELECT *, greatest(floor({scaled("-")} + 0.5)::BIGINT - 1, 0) AS low_,
                CASE WHEN {share} > 0 THEN floor({scaled("+")} + 0.5)::BIGINT + 1 ELSE 0 END AS high_
              FROM (SELECT *, count(*) OVER ({over}) AS m_, sum({share}) OVER ({over}) AS t_ FROM {rows})))))
      GROUP BY {keep}, low_"""


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS code FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ([3.0::DOUBLE, 1.0, 2.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
  source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS whole FROM sources),
levels AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS nth FROM weighed),
fixed AS (SELECT arg_min(level, nth) AS level FROM levels WHERE level <= cap / weight),
aimed AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM fixed) * weight), cap) AS target FROM levels),
seated AS (SELECT *, round(sum(target) OVER () / 32)::BIGINT AS seats FROM aimed),
quotas AS ({_rank_seats("seated", "", "source", "target", "seats", "source, source_size, target")}),
placed AS (SELECT s.*, q.source_size, q.target, q.quota AS source_quota,
  ('0x' || substr(code, 1, 8))::BIGINT % greatest(ceil(q.source_size / 4000000.0)::BIGINT, 1) AS shard
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source),
shards AS (SELECT source, shard, source_quota, sum(size)::BIGINT AS shard_size, sum(size)::DOUBLE AS share FROM placed GROUP BY source, shard, source_quota),
dealt AS ({_rank_seats("shards", "source", "shard", "share", "source_quota", "source, shard, source_quota, shard_size, share")}),
blocked AS (SELECT source, shard, b AS blocks, least(quota, b * 2) AS quota,
  ('0x' || substr(md5('mix#' || coalesce(source, '') || '#' || shard), 1, 8))::BIGINT % greatest(b, 1) AS turn
  FROM (SELECT *, ceil(shard_size / 32.0)::BIGINT AS b FROM dealt)),
lined AS (SELECT p.*, b.blocks, b.turn, CASE WHEN b.blocks > 0 THEN b.quota // b.blocks ELSE 0 END AS passes,
  CASE WHEN b.blocks > 0 THEN b.quota % b.blocks ELSE 0 END AS rest,
  sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY code, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
  FROM placed p JOIN blocked b ON p.source IS NOT DISTINCT FROM b.source AND p.shard = b.shard),
ends AS (SELECT *, stop // 32 AS b1, stop % 32 AS r1, (stop - size) // 32 AS b0, (stop - size) % 32 AS r0 FROM lined),
steps AS (SELECT *, ((b1 + turn) * rest) // greatest(blocks, 1) AS g1, ((b1 + 1 + turn) * rest) // greatest(blocks, 1) AS h1,
  ((b0 + turn) * rest) // greatest(blocks, 1) AS g0, ((b0 + 1 + turn) * rest) // greatest(blocks, 1) AS h0 FROM ends)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN passes * size + 32 * (g1 - g0) + r1 * (h1 - g1) - r0 * (h0 - g0) ELSE 0 END::BIGINT AS taken FROM steps
"""
