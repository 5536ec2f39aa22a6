"""The retriever: one object that tokenises, indexes, searches, saves and loads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import ENGLISH_STOPWORDS, Stopwords, resolve_stopwords, tokenise
from .operators import retrieve as rt
from .operators.index import Config, Index, Stemmer, build_index, tokens_of
from .sources import index_store, jsonl


class Retriever:
    """BM25 retrieval over a DataFrame of texts. Stopword iterables are read once, here."""

    def __init__(
        self, k1: float = 1.5, b: float = 0.75, delta: float = 0.5, method: str = "lucene", idf_method: str | None = None, stopwords: Stopwords = ENGLISH_STOPWORDS, stemmer: Stemmer = None
    ):
        self.config = Config(k1, b, delta, method, idf_method)
        self.stopwords = None if stopwords is None else resolve_stopwords(stopwords)
        self.stemmer = stemmer
        self._index: Index | None = None

    @property
    def indexed(self) -> Index:
        if self._index is None:
            raise RuntimeError("nothing is indexed yet; call index() or load()")
        return self._index

    def index(self, corpus: DataFrame | Iterable[str], *, id_col: str = "doc_id", text_col: str = "text") -> Retriever:
        """Replaces what was indexed before, and only once the new index stands."""
        if not isinstance(corpus, DataFrame):
            corpus = jsonl.in_memory(SparkSession.active(), corpus)
        if corpus.isEmpty():
            raise ValueError("the corpus is empty")
        self._index = build_index(tokens_of(corpus, id_col=id_col, text_col=text_col, stopwords=self.stopwords), self.config, self.stemmer)
        return self

    def persist(self) -> Retriever:
        """Keeps postings and terms for many batches of queries."""
        self.indexed.postings.persist()
        self.indexed.terms.persist()
        return self

    def query_terms(self, queries: DataFrame | Iterable[str]) -> tuple[DataFrame, DataFrame]:
        """The queries ``(query_id, text)`` and their terms."""
        if not isinstance(queries, DataFrame):
            queries = jsonl.in_memory(SparkSession.active(), queries, "query_id")
        return queries, rt.query_terms(queries.select("query_id", tokenise(F.col("text"), self.stopwords).alias("tokens")), self.stemmer)

    def retrieve(self, queries: DataFrame | Iterable[str], k: int = 10, *, fill: bool = False, padded: bool = False, add_offset: bool = True, weights: DataFrame | None = None) -> DataFrame:
        """``(query_id, rank, doc_id, score)``. ``fill`` adds unmatched documents up to k, ``padded`` rows of
        document 0 and score 0; ``weights(doc_id, weight)`` multiply scores before the cut."""
        index = self.indexed
        if k < 1:
            raise ValueError("k must be at least 1")
        queries, terms = self.query_terms(queries)
        scores = rt.score(index, terms, add_offset=add_offset)
        hits = rt.top_k(rt.weigh(scores, weights) if weights is not None else scores, k)
        if fill:
            hits = rt.filled(hits, queries, index.docs, k, rt.offsets(terms, index) if add_offset and index.config.shifted else None)
        return rt.padded(hits, queries, k) if padded else hits

    def save(self, path: str) -> None:
        index_store.save_index(self.indexed, path, stopwords=index_store.stopwords_to_json(self.stopwords), stemmer=index_store.stemmer_name(self.stemmer))

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Retriever:
        """An index saved with a stemmer of one's own loads without it; set ``stemmer`` again before searching."""
        index = index_store.load_index(spark or SparkSession.active(), path)
        stemmer = index.extras.get("stemmer", "none")
        c = index.config
        loaded = cls(c.k1, c.b, c.delta, c.method, c.idf_method, index_store.stopwords_from_json(index.extras.get("stopwords", "default")), stemmer if stemmer == "porter" else None)
        loaded._index = index
        return loaded
