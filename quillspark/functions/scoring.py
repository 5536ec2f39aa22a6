"""The five term-frequency and five inverse-document-frequency components, as Column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("robertson", "lucene", "atire", "bm25l", "bm25+")
#: Methods under which a document without the term still scores.
SHIFTED = frozenset(("bm25l", "bm25+"))


def _saturated(tf: Column, norm: Column, k1: float, delta: float) -> Column:
    return tf / (norm * k1 + tf)


def _atire(tf: Column, norm: Column, k1: float, delta: float) -> Column:
    return tf * (k1 + 1) / (tf + norm * k1)


def _bm25l(tf: Column, norm: Column, k1: float, delta: float) -> Column:
    scaled = tf / norm + delta
    return scaled * (k1 + 1) / (scaled + k1)


def _bm25_plus(tf: Column, norm: Column, k1: float, delta: float) -> Column:
    return _atire(tf, norm, k1, delta) + delta


TFC: dict[str, Callable[[Column, Column, float, float], Column]] = {
    "robertson": _saturated,
    "lucene": _saturated,
    "atire": _atire,
    "bm25l": _bm25l,
    "bm25+": _bm25_plus,
}


def check_method(method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    return method


def score_tfc(method: str, tf: Column, l_d: Column, l_avg: Column, k1: float = 1.5, b: float = 0.75, delta: float = 0.0) -> Column:
    norm = F.lit(1 - b) + F.lit(b) * l_d.cast("double") / l_avg
    return TFC[check_method(method)](tf.cast("double"), norm, k1, delta)


def score_idf(method: str, df: Column, n_docs: Column, allow_negative: bool = False) -> Column:
    """Natural logarithms. Where IEEE arithmetic would divide by a df of 0 the result is Infinity.

    ``allow_negative`` only concerns robertson, which is else at least 0."""
    df, n = df.cast("double"), n_docs.cast("double")
    odds = (n - df + 0.5) / (df + 0.5)
    match check_method(method):
        case "robertson":
            return F.ln(odds if allow_negative else F.greatest(odds, F.lit(1.0)))
        case "lucene":
            return F.ln(odds + 1)
        case "bm25l":
            return F.ln((n + 1) / (df + 0.5))
        case other:
            ratio = n if other == "atire" else n + 1
            return F.when(df > 0, F.ln(ratio / F.nullif(df, F.lit(0.0)))).otherwise(F.lit(float("inf")))


def nonoccurrence_tfc(method: str, k1: float, b: float, delta: float) -> float:
    """The term-frequency part of an absent term in a document of average length."""
    return {"bm25l": (k1 + 1) * delta / (k1 + delta) if delta else 0.0, "bm25+": delta}.get(method, 0.0)
