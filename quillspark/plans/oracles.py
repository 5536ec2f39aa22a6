"""SQL for the registered queries, written apart from the engine: common table expressions over the raw tables."""

from __future__ import annotations

from ..functions import stemmer
from ..functions.scoring import SHIFTED
from ..functions.text import ENGLISH_STOPWORDS, TOKEN_PATTERN

WORDS = ", ".join(f"'{w}'" for w in sorted(ENGLISH_STOPWORDS))


def tokens(text: str, stopwords: str | None = WORDS, lowercase: bool = True) -> str:
    source = f"coalesce({text}, '')"
    found = f"regexp_extract_all({f'lower({source})' if lowercase else source}, '{TOKEN_PATTERN}')"
    return f"list_filter({found}, lambda t: t NOT IN ({stopwords}))" if stopwords else found


def tfc(method: str, tf: str, l_d: str, l_avg: str, k1: float, b: float, delta: float) -> str:
    norm = f"({1 - b}::DOUBLE + {b}::DOUBLE * {l_d} / {l_avg})"
    plus = f"{tf} * ({k1}::DOUBLE + 1) / ({k1}::DOUBLE * {norm} + {tf})"
    return {
        "robertson": f"{tf} / ({k1}::DOUBLE * {norm} + {tf})",
        "lucene": f"{tf} / ({k1}::DOUBLE * {norm} + {tf})",
        "atire": plus,
        "bm25l": f"({k1}::DOUBLE + 1) * ({tf} / {norm} + {delta}::DOUBLE) / ({k1}::DOUBLE + {tf} / {norm} + {delta}::DOUBLE)",
        "bm25+": f"{plus} + {delta}::DOUBLE",
    }[method]


def idf(method: str, df: str, n: str, allow_negative: bool = False) -> str:
    odds = f"({n} - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE)"
    return {
        "robertson": f"ln({odds})" if allow_negative else f"ln(greatest({odds}, 1.0::DOUBLE))",
        "lucene": f"ln(1 + {odds})",
        "atire": f"ln({n}::DOUBLE / {df})",
        "bm25l": f"ln(({n} + 1)::DOUBLE / ({df} + 0.5::DOUBLE))",
        "bm25+": f"ln(({n} + 1)::DOUBLE / {df})",
    }[method]


def absent(method: str, k1: float, delta: float) -> float:
    return {"bm25l": (k1 + 1) * delta / (k1 + delta), "bm25+": delta}.get(method, 0.0)


def corpus(table: str = "documents", doc_id: str = "doc_id", text: str = "text", **options) -> str:
    return f"corpus AS MATERIALIZED (SELECT {doc_id} AS doc_id, {tokens(text, **options)} AS tokens FROM {table})"


def raw_terms(stem: bool = False) -> str:
    base = "raw AS (SELECT doc_id, len(tokens) AS l_d, unnest(tokens) AS token FROM corpus)"
    if not stem:
        return f"{base}, tf AS MATERIALIZED (SELECT doc_id, l_d, token, count(*) AS tf FROM raw GROUP BY ALL)"
    return f"{base}, words AS (SELECT DISTINCT token FROM raw), {stems('words')}, tf AS (SELECT doc_id, l_d, stem AS token, count(*) AS tf FROM raw JOIN stems USING (token) GROUP BY ALL)"


def match(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, '{pattern}')"


def stems(words: str) -> str:
    steps = stemmer.steps(match)
    chain = ", ".join(f"s{i} AS (SELECT token, {step} AS w FROM {'(SELECT token, token AS w FROM ' + words + ')' if i == 0 else f's{i - 1}'})" for i, step in enumerate(steps))
    return f"{chain}, stems AS (SELECT token, CASE WHEN NOT {stemmer.stemmable(match)} THEN token ELSE coalesce({stemmer.fixed()}, w) END AS stem FROM s{len(steps) - 1})"


def index(method: str, idf_method: str | None = None, k1: float = 1.5, b: float = 0.75, delta: float = 0.5, stem: bool = False, **source) -> str:
    """CTEs corpus, tf, stats, terms, postings."""
    gone = absent(method, k1, delta) if method in SHIFTED else 0.0
    return f"""{corpus(**source)}, {raw_terms(stem)},
stats AS (SELECT count(*) AS n_docs, coalesce(avg(len(tokens)), 0.0) AS l_avg FROM corpus),
terms AS (SELECT token, df, idf, idf * {gone}::DOUBLE AS nonoccurrence FROM (
  SELECT token, count(*) AS df, {idf(idf_method or method, 'count(*)', 'any_value(n_docs)')} AS idf FROM tf, stats GROUP BY token)),
postings AS (SELECT token, doc_id, tf, ({tfc(method, 'tf', 'l_d', 'l_avg', k1, b, delta)}) * idf - nonoccurrence AS score FROM tf JOIN terms USING (token), stats)"""


def query_terms(queries: str = "benchmark", query_id: str = "item_id", text: str = "text", stem: bool = False) -> str:
    base = f"qraw AS (SELECT {query_id} AS query_id, unnest({tokens(text)}) AS token FROM {queries})"
    if not stem:
        return f"{base}, q AS (SELECT query_id, token, count(*) AS tf FROM qraw GROUP BY ALL)"
    return f"{base}, qwords AS (SELECT DISTINCT token FROM qraw), q AS (SELECT query_id, stem AS token, count(*) AS tf FROM qraw JOIN ({'WITH ' + stems('qwords') + ' SELECT * FROM stems'}) USING (token) GROUP BY ALL)"


HITS = """scores AS (SELECT query_id, doc_id, round(sum(p.score * q.tf) + any_value(coalesce(offsets.offset_, 0)), 6) AS score
  FROM postings p JOIN q USING (token) LEFT JOIN offsets USING (query_id) GROUP BY query_id, doc_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores)"""
OFFSETS = "offsets AS (SELECT query_id, sum(q.tf * t.nonoccurrence) AS offset_ FROM q JOIN terms t USING (token) GROUP BY query_id)"


def hits(method: str, idf_method: str | None = None, queries: str | None = None, stem: bool = False, **source) -> str:
    return f"WITH {index(method, idf_method, stem=stem, **source)}, {queries or query_terms(stem=stem)}, {OFFSETS}, {HITS}"


def top_k(method: str, idf_method: str | None = None, k: int = 10, **options) -> str:
    return f"{hits(method, idf_method, **options)} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"
