"""Importers of headerless little-endian vectors and length-prefixed vocabularies, and of a column-sparse matrix."""

from __future__ import annotations

import struct
from array import array

from pyspark.sql import DataFrame, SparkSession


def read_vector(data: bytes, code: str) -> list:
    """Values of ``<f4`` (code ``f``) or ``<i4`` (code ``i``)."""
    if len(data) % 4:
        raise ValueError("the data is cut off: not a whole number of 4-byte values")
    return list(struct.unpack(f"<{len(data) // 4}{code}", data))


def write_vector(values, code: str) -> bytes:
    return struct.pack(f"<{len(values)}{code}", *values)


def write_vocab(tokens: list[str]) -> bytes:
    """A count, then each token's byte length and UTF-8 bytes; numbers are unsigned 32-bit little-endian."""
    encoded = [t.encode() for t in tokens]
    return struct.pack("<I", len(encoded)) + b"".join(struct.pack("<I", len(t)) + t for t in encoded)


def read_vocab(data: bytes) -> list[str]:
    def number(at: int) -> int:
        if at + 4 > len(data):
            raise ValueError("the vocabulary is cut off")
        return struct.unpack_from("<I", data, at)[0]

    tokens, at = [], 4
    for _ in range(number(0)):
        size = number(at)
        at += 4
        if at + size > len(data):
            raise ValueError("the vocabulary is cut off")
        tokens.append(data[at : at + size].decode())
        at += size
    if at != len(data):
        raise ValueError("there are bytes after the vocabulary's end")
    return tokens


def from_csc(spark: SparkSession, data, indices, indptr) -> DataFrame:
    """``matrix(token_id, doc_id, score float)`` from a column-sparse triple, for ``score_matrix``."""
    if isinstance(data, array) and data.typecode != "f":
        raise ValueError("the score matrix must hold 32-bit floats")
    if indptr[-1] != len(data) or len(indices) != len(data):
        raise ValueError("data, indices and indptr do not agree in length")
    rows = [(t, int(indices[i]), float(data[i])) for t in range(len(indptr) - 1) for i in range(indptr[t], indptr[t + 1])]
    return spark.createDataFrame(rows, "token_id int, doc_id int, score float")
