"""Registered queries over the engine's own operators, each over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import METHODS, score_idf, score_tfc
from ..functions.text import jaccard, tokenise
from ..operators import index as ix
from ..operators import retrieve as rt
from ..operators.vocab import build_vocab, encode
from ..sources.shared import cut, in_all_cores, shared_path
from . import oracles as sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CUSTOM = ("erth", "the", "und")
FIRST_WORDS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, oracle: str | None = None):
    def add(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


def plain(method: str) -> str:
    return method.replace("+", "plus")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.tokens_of(in_all_cores(table(spark, sf_dir, "documents")))


def benchmark_terms(spark: SparkSession, sf_dir: str, stemmer: ix.Stemmer = None) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokenise(F.col("text")).alias("tokens"))
    return rt.query_terms(items, stemmer)


def index_for(spark: SparkSession, sf_dir: str, terms: DataFrame, config: ix.Config = ix.Config(), stemmer: ix.Stemmer = None) -> tuple[ix.Index, DataFrame]:
    """An index of all documents that holds the terms of the queries, which are all that is asked of it, and the cut terms."""
    terms = cut(terms, "query-terms")
    return ix.build_index(corpus(spark, sf_dir), config, stemmer, only=terms), terms


def search(spark: SparkSession, sf_dir: str, config: ix.Config = ix.Config(), k: int = 10, stemmer: ix.Stemmer = None) -> DataFrame:
    return rt.top_k(rt.score(*index_for(spark, sf_dir, benchmark_terms(spark, sf_dir, stemmer), config, stemmer)), k, rt.DIGITS)


# tokenising


def _tokenised(name: str, oracle_options: dict, **options) -> None:
    @register(name, f"WITH {sql.corpus(**oracle_options)} SELECT doc_id, len(tokens)::BIGINT AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM corpus")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = ix.tokens_of(in_all_cores(table(spark, sf_dir, "documents")), **options)
        return found.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


_tokenised("tokenize_docs", {})
_tokenised("tokenize_no_stopwords", {"stopwords": None}, stopwords=None)
_tokenised("tokenize_custom_stopwords", {"stopwords": ", ".join(f"'{w}'" for w in CUSTOM)}, stopwords=CUSTOM)
_tokenised("tokenize_case_preserved", {"lowercase": False}, lowercase=False)


@register("token_length_stats", f"WITH {sql.corpus()} SELECT count(*) AS n_docs, round(avg(len(tokens)), 6) AS l_avg FROM corpus")
def token_length_stats(spark, sf_dir):
    return ix.corpus_stats(corpus(spark, sf_dir)).select("n_docs", F.round("l_avg", 6).alias("l_avg"))


@register(
    "token_overlap",
    f"""WITH a AS (SELECT doc_id, list_distinct({sql.tokens('text', None)}) AS x, list_distinct({sql.tokens('text')}) AS y FROM documents)
    SELECT doc_id, round(CASE WHEN len(x) = 0 THEN 1.0 ELSE len(y)::DOUBLE / len(x) END, 9) AS overlap FROM a""",
)
def token_overlap(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(jaccard(tokenise(text, None), tokenise(text)), 9).alias("overlap"))


# vocabulary

VOCAB = """raw_pos AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM corpus),
vocab AS (SELECT token, (row_number() OVER (ORDER BY doc_id, pos) - 1)::INT AS token_id FROM (
  SELECT token, doc_id, pos FROM raw_pos QUALIFY row_number() OVER (PARTITION BY token ORDER BY doc_id, pos) = 1))"""


@register("vocab_first_occurrence", f"WITH {sql.corpus()}, {VOCAB} SELECT token, token_id FROM vocab")
def vocab_first_occurrence(spark, sf_dir):
    return build_vocab(corpus(spark, sf_dir))


@register(
    "tokens_to_ids_oov",
    f"""WITH {sql.corpus()}, {VOCAB}, items AS (SELECT item_id, {sql.tokens('text')} AS tokens FROM benchmark),
    flat AS (SELECT item_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM items)
    SELECT item_id, pos::BIGINT AS pos, token, coalesce(token_id, -1) AS token_id FROM flat LEFT JOIN vocab USING (token)""",
)
def tokens_to_ids_oov(spark, sf_dir):
    items = ix.tokens_of(table(spark, sf_dir, "benchmark"), id_col="item_id")
    return encode(items, build_vocab(corpus(spark, sf_dir))).select(F.col("doc_id").alias("item_id"), F.col("pos").cast("long").alias("pos"), "token", "token_id")


# counts


@register("term_freq", f"WITH {sql.corpus()}, {sql.raw_terms()} SELECT doc_id, token, tf FROM tf")
def term_freq(spark, sf_dir):
    return ix.term_frequencies(corpus(spark, sf_dir)).select("doc_id", "token", "tf")


@register("doc_freq", f"WITH {sql.corpus()}, {sql.raw_terms()} SELECT token, count(*) AS df FROM tf GROUP BY token")
def doc_freq(spark, sf_dir):
    return ix.term_frequencies(corpus(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("df"))


@register(
    "csc_indptr",
    f"""WITH {sql.corpus()}, {VOCAB}, {sql.raw_terms()}, d AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
    SELECT token_id, coalesce(sum(df) OVER (ORDER BY token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS indptr FROM vocab JOIN d USING (token)
    UNION ALL SELECT count(*)::INT, sum(df)::BIGINT FROM d""",
)
def csc_indptr(spark, sf_dir):
    tokens = corpus(spark, sf_dir)
    vocab = build_vocab(tokens)
    counts = ix.term_frequencies(tokens).groupBy("token").agg(F.count("*").alias("df")).join(vocab, "token").select("token_id", "df")
    return ix.column_pointers(vocab, counts)


@register("index_size", f"WITH {sql.corpus()}, {sql.raw_terms()} SELECT count(*) AS nnz, count(DISTINCT token) AS n_vocab FROM tf")
def index_size(spark, sf_dir):
    return ix.term_frequencies(corpus(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("n")).agg(F.sum("n").alias("nnz"), F.count("*").alias("n_vocab"))


# scoring components


def _components(method: str) -> None:
    body = sql.tfc(method, "tf", "l_d", "l_avg", 1.5, 0.75, 1.0)
    stats = "stats AS (SELECT avg(len(tokens)) AS l_avg, count(*) AS n FROM corpus)"

    @register(f"tfc_{plain(method)}", f"WITH {sql.corpus()}, {sql.raw_terms()}, {stats} SELECT doc_id, token, round({body}, 6) AS tfc FROM tf, stats")
    def tfc(spark, sf_dir):
        tokens = corpus(spark, sf_dir)
        l_avg = ix.corpus_stats(tokens).first()["l_avg"]
        return ix.term_frequencies(tokens).select("doc_id", "token", F.round(score_tfc(method, F.col("tf"), F.col("l_d"), F.lit(l_avg), delta=1.0), 6).alias("tfc"))

    def idf(name: str, negative: bool) -> None:
        @register(name, f"WITH {sql.corpus()}, {sql.raw_terms()}, {stats}, d AS (SELECT token, count(*) AS df FROM tf GROUP BY token) SELECT token, df, round({sql.idf(method, 'df', 'n', negative)}, 6) AS idf FROM d, stats")
        def run(spark, sf_dir):
            tokens = corpus(spark, sf_dir)
            n = ix.corpus_stats(tokens).first()["n_docs"]
            counts = ix.term_frequencies(tokens).groupBy("token").agg(F.count("*").alias("df"))
            return counts.select("token", "df", F.round(score_idf(method, F.col("df"), F.lit(n), negative), 6).alias("idf"))

    idf(f"idf_{plain(method)}", False)
    if method == "robertson":
        idf("idf_robertson_negative", True)

    @register(f"postings_{plain(method)}", f"WITH {sql.index(method)} SELECT token, doc_id, tf, round(score, 6) AS score FROM postings")
    def postings(spark, sf_dir):
        return ix.build_index(corpus(spark, sf_dir), ix.Config(method=method)).postings.withColumn("score", F.round("score", 6))

    if method in ("bm25l", "bm25+"):

        @register(f"nonoccurrence_{plain(method)}", f"WITH {sql.index(method)} SELECT token, df, round(nonoccurrence, 6) AS nonoccurrence FROM terms")
        def nonoccurrence(spark, sf_dir):
            terms = ix.build_index(corpus(spark, sf_dir), ix.Config(method=method)).terms
            return terms.select("token", "df", F.round("nonoccurrence", 6).alias("nonoccurrence"))

    for idf_method in METHODS:
        name = f"bm25_{plain(method)}_topk" if idf_method == method else f"bm25_mixed_{plain(method)}_{plain(idf_method)}"

        @register(name, sql.top_k(method, idf_method))
        def topk(spark, sf_dir, idf_method=idf_method):
            return search(spark, sf_dir, ix.Config(method=method, idf_method=idf_method))


for _method in METHODS:
    _components(_method)


# accumulation


@register("score_accumulate", f"{sql.hits('lucene')} SELECT query_id, doc_id, score FROM scores")
def score_accumulate(spark, sf_dir):
    return rt.score(*index_for(spark, sf_dir, benchmark_terms(spark, sf_dir))).withColumn("score", F.round("score", 6))


ONE_QUERY = "qraw AS (SELECT 0 AS query_id, unnest({}) AS token FROM (SELECT string_agg(text, ' ' ORDER BY item_id) AS text FROM benchmark)), q AS (SELECT query_id, token, count(*) AS tf FROM qraw GROUP BY ALL)".format(sql.tokens("text"))


def one_query(spark, sf_dir) -> DataFrame:
    """All benchmark items as one long query: one score per document, and many repeated terms."""
    terms = benchmark_terms(spark, sf_dir).groupBy("token").agg(F.sum("tf").alias("tf"))
    return terms.select(F.lit(0).alias("query_id"), "token", "tf")


@register(
    "score_into_priors",
    f"{sql.hits('lucene', queries=ONE_QUERY)} SELECT d.doc_id, round(d.n_chars / 1000.0::DOUBLE + coalesce(s.score, 0), 6) AS score FROM documents d LEFT JOIN scores s USING (doc_id)",
)
def score_into_priors(spark, sf_dir):
    scores = rt.score(*index_for(spark, sf_dir, one_query(spark, sf_dir))).withColumn("score", F.round("score", 6))
    priors = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("prior"))
    return rt.add_priors(priors, scores).withColumn("score", F.round("score", 6))


@register(
    "score_weight_mask",
    f"""{sql.hits('lucene')}, w AS (SELECT doc_id, quality::DOUBLE + 1 AS weight FROM labels),
    v AS (SELECT query_id, doc_id, round(score * coalesce(weight, 1.0), 6) AS score FROM scores LEFT JOIN w USING (doc_id))
    SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM v) WHERE rank <= 10""",
)
def score_weight_mask(spark, sf_dir):
    scores = rt.score(*index_for(spark, sf_dir, benchmark_terms(spark, sf_dir))).withColumn("score", F.round("score", 6))
    weights = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1.0).alias("weight"))
    return rt.top_k(rt.weigh(scores, weights), 10, rt.DIGITS)


# top-k and its edges


@register("topk_global", f"{sql.hits('lucene', queries=ONE_QUERY)} SELECT doc_id, score FROM scores ORDER BY score DESC, doc_id LIMIT 25")
def topk_global(spark, sf_dir):
    scores = rt.score(*index_for(spark, sf_dir, one_query(spark, sf_dir))).select("doc_id", F.round("score", 6).alias("score"))
    return rt.top_k_global(scores, 25)


@register("topk_k_exceeds_n", sql.top_k("atire", k=1_000_000_000))
def topk_k_exceeds_n(spark, sf_dir):
    return search(spark, sf_dir, ix.Config(method="atire"), k=1_000_000_000)


TWICE = "qraw AS (SELECT item_id AS query_id, unnest({}) AS token FROM benchmark), q AS (SELECT query_id, token, count(*) AS tf FROM qraw GROUP BY ALL)".format(sql.tokens("text || ' ' || text"))


@register("retrieve_duplicate_terms", sql.top_k("lucene", queries=TWICE))
def retrieve_duplicate_terms(spark, sf_dir):
    doubled = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokenise(F.concat_ws(" ", "text", "text")).alias("tokens"))
    return rt.top_k(rt.score(*index_for(spark, sf_dir, rt.query_terms(doubled))), 10, rt.DIGITS)


UNKNOWN = "q AS (SELECT item_id AS query_id, 'zzqx' || item_id AS token, 1 AS tf FROM benchmark)"


@register("retrieve_oov_only", f"{sql.hits('lucene', queries=UNKNOWN)} SELECT item_id AS query_id, r.doc_id, coalesce(r.score, 0.0)::DOUBLE AS score FROM benchmark LEFT JOIN ranked r ON r.query_id = item_id")
def retrieve_oov_only(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    terms = items.select("query_id", F.concat(F.lit("zzqx"), F.col("query_id").cast("string")).alias("token"), F.lit(1).cast("long").alias("tf"))
    hits = rt.score(*index_for(spark, sf_dir, terms))
    return items.join(hits, "query_id", "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


RARE = f"""rare AS (SELECT item_id AS query_id, token FROM (SELECT item_id, unnest(list_distinct({sql.tokens('text')})) AS token FROM benchmark)
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(token) DESC, token) <= {FIRST_WORDS}), q AS (SELECT query_id, token, 1 AS tf FROM rare)"""


def rare_terms(spark, sf_dir) -> DataFrame:
    """The longest tokens of each item: short queries that match few documents."""
    longest = F.slice(F.array_sort(F.transform(F.array_distinct(tokenise(F.col("text"))), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("token")))), 1, FIRST_WORDS)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(longest).alias("t")).select("query_id", F.col("t.token").alias("token"), F.lit(1).cast("long").alias("tf"))


@register(
    "retrieve_fill",
    f"""{sql.hits('bm25+', queries=RARE)}, every AS (SELECT item_id AS query_id, d.doc_id FROM benchmark, corpus d),
    best AS (SELECT e.query_id, e.doc_id, r.score IS NULL AS missing, coalesce(r.score, round(coalesce(o.offset_, 0), 6)) AS score
      FROM every e LEFT JOIN (SELECT * FROM ranked WHERE rank <= 20) r USING (query_id, doc_id) LEFT JOIN offsets o USING (query_id))
    SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY missing, CASE WHEN missing THEN 0 ELSE -score END, doc_id) AS rank, doc_id, score FROM best) WHERE rank <= 20""",
)
def retrieve_fill(spark, sf_dir):
    index, terms = index_for(spark, sf_dir, rare_terms(spark, sf_dir), ix.Config(method="bm25+"))
    hits = rt.top_k(rt.score(index, terms), 20, rt.DIGITS)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return rt.filled(hits, items, index.docs, 20, rt.offsets(terms, index))


@register(
    "retrieve_padded",
    f"""{sql.hits('lucene', queries=RARE)}, grid AS (SELECT item_id AS query_id, unnest(range(1, 13)) AS rank FROM benchmark)
    SELECT query_id, rank, coalesce(doc_id, 0) AS doc_id, coalesce(score, 0.0) AS score FROM grid LEFT JOIN ranked USING (query_id, rank)""",
)
def retrieve_padded(spark, sf_dir):
    hits = rt.top_k(rt.score(*index_for(spark, sf_dir, rare_terms(spark, sf_dir))), 12, rt.DIGITS)
    return rt.padded(hits, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")), 12)


@register(
    "results_collected",
    f"""{sql.hits('lucene')} SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids FROM ranked WHERE rank <= 10 GROUP BY query_id""",
)
def results_collected(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return rt.collected(search(spark, sf_dir), items).select("query_id", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"))


# stemming


@register("stem_vocab", f"WITH {sql.corpus()}, words AS (SELECT DISTINCT unnest(tokens) AS token FROM corpus), {sql.stems('words')} SELECT token, stem FROM stems")
def stem_vocab(spark, sf_dir):
    return ix.stem_map(corpus(spark, sf_dir).select(F.explode("tokens").alias("token")).distinct(), "porter")


@register("bm25_stemmed_topk", sql.top_k("lucene", stem=True))
def bm25_stemmed_topk(spark, sf_dir):
    return search(spark, sf_dir, stemmer="porter")


# other corpora

CONVERSATIONS = {"table": "(SELECT conv_id, string_agg(text, ' ' ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id)", "doc_id": "conv_id"}


@register("conversations_search", sql.top_k("lucene", **CONVERSATIONS))
def conversations_search(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))  # turns of one conversation
    whole = turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["text"]), " ").alias("text"))
    terms = cut(benchmark_terms(spark, sf_dir), "query-terms")
    index = ix.build_index(ix.tokens_of(whole, id_col="conv_id"), only=terms)
    return rt.top_k(rt.score(index, terms), 10, rt.DIGITS)


@register("pages_search", sql.top_k("lucene", table="pages", doc_id="page_id", text="regexp_replace(html, '<[^>]*>', ' ', 'g')"))
def pages_search(spark, sf_dir):
    pages = in_all_cores(table(spark, sf_dir, "pages")).select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    terms = cut(benchmark_terms(spark, sf_dir), "query-terms")
    index = ix.build_index(ix.tokens_of(pages, id_col="page_id"), only=terms)
    return rt.top_k(rt.score(index, terms), 10, rt.DIGITS)


@register("smoke_sum", "SELECT sum(i)::BIGINT AS total FROM range(1, 5) t(i)")
def smoke_sum(spark, sf_dir):
    return spark.range(1, 5).agg(F.sum("id").alias("total"))


# persistence


@register("index_roundtrip", sql.top_k("lucene"))
def index_roundtrip(spark, sf_dir):
    """Saves an index, loads it, and searches what was loaded."""
    from ..sources.index_store import load_index, save_index

    path = shared_path(spark, "index")
    save_index(ix.build_index(corpus(spark, sf_dir)), path)
    return rt.top_k(rt.score(load_index(spark, path), benchmark_terms(spark, sf_dir)), 10, rt.DIGITS)
