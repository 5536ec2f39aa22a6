"""Tokenising: lower-case, split into word runs, drop stopwords. All in JVM expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of two or more letters, digits and underscores; the same language in Java and RE2.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

ENGLISH_STOPWORDS = frozenset(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)

Stopwords = str | Iterable[str] | None


def resolve_stopwords(stopwords: Stopwords) -> frozenset[str]:
    """None: no stopwords; "en" or "english" in any case: the built-in list; else the given words."""
    if stopwords is None:
        return frozenset()
    if isinstance(stopwords, str):
        if stopwords.lower() not in ("en", "english"):
            raise ValueError(f"no stopword list named {stopwords!r}; known: 'en', 'english'")
        return ENGLISH_STOPWORDS
    return frozenset(stopwords)


def tokenise(text: Column, stopwords: Stopwords = ENGLISH_STOPWORDS, lowercase: bool = True) -> Column:
    """array<string> of the text's tokens in order, duplicates kept; a null text has none.

    Stopwords are compared after lower-casing, and filtered one by one, so repeats survive."""
    text = F.coalesce(text, F.lit(""))
    tokens = F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(TOKEN_PATTERN), F.lit(0))
    dropped = sorted(resolve_stopwords(stopwords))
    return F.filter(tokens, lambda t: ~t.isin(dropped)) if dropped else tokens


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token lists as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
