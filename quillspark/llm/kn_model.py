"""Interpolated modified Kneser-Ney character model: n-grams of a text, discounts, and sorted tables to look them up.

Characters are what they are, in any script; only digits fall into one and so does white space. The
number of different n-grams grows with the corpus, so the tables come in shards."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

ORDER = 5
START, END = "\x02", "\x03"
SLICE = 1 << 19
UNKNOWN = np.uint32(0xFFFD)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _characters() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    table[0xD800:0xE000] = UNKNOWN
    for code in range(0x110000):
        if code < 0xD800 or code > 0xDFFF:
            char = chr(code)
            if char.isspace() or char in "\x00\x02\x03":
                table[code] = ord(" ")
            elif char.isdigit():
                table[code] = ord("0")
    return table


CHARACTERS = _characters()


def pieces(text: str) -> Iterator[np.ndarray]:
    """The text's characters and its end, in pieces of at most ``SLICE`` that each begin with the ``ORDER - 1`` before."""
    past = np.full(ORDER - 1, ord(START), dtype=np.uint32)
    for at in range(0, len(text) + 1, SLICE):
        codes = CHARACTERS[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        if at + SLICE > len(text):
            codes = np.append(codes, np.uint32(ord(END)))
        line = np.concatenate((past, codes))
        past = line[len(line) - (ORDER - 1) :]
        yield line


def slices(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(characters, owner, places): pieces of several texts in one line of about ``SLICE``, the places of the
    characters that count, and the number of the text that each belongs to."""
    lines: list[np.ndarray] = []
    owners: list[int] = []
    held = 0

    def packed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(line) for line in lines])
        begins = np.cumsum(sizes) - sizes
        n = sizes - (ORDER - 1)
        first = np.cumsum(n) - n
        places = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(begins + ORDER - 1, n)
        return np.concatenate(lines), np.repeat(np.array(owners), n), places

    for i, text in enumerate(texts):
        for line in pieces(text):
            lines.append(line)
            owners.append(i)
            held += len(line)
            if held >= SLICE:
                yield packed()
                lines, owners, held = [], [], 0
    if lines:
        yield packed()


def keys(line: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the ``k`` characters that end at each place."""
    found = np.full(len(places), k, dtype=np.uint64)
    for j in range(k - 1, -1, -1):
        found = found * _MIX + line[places - j].astype(np.uint64)
        found ^= found >> np.uint64(29)
    return found


def gram_keys(grams: list[str], k: int) -> np.ndarray:
    """The hashes of strings of ``k`` characters."""
    if not k or not grams:
        return np.full(len(grams), k, dtype=np.uint64)
    line = np.frombuffer("".join(grams).encode("utf-32-le"), dtype=np.uint32)
    return keys(line, np.arange(k - 1, len(line), k), k)


def different(line: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each different n-gram, number of the n-gram at each place)."""
    coded = pa.array(keys(line, places, ORDER)).dictionary_encode()
    codes = coded.indices.to_numpy()
    first = np.empty(len(coded.dictionary), dtype=np.int64)
    first[codes[::-1]] = places[::-1]
    return first, codes


def strings(line: np.ndarray, places: np.ndarray) -> list[str]:
    """The n-grams that end at ``places``."""
    grams = np.ascontiguousarray(line[places[:, None] + np.arange(1 - ORDER, 1)[None, :]])
    return grams.view(f"U{ORDER}").ravel().tolist()


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the counts of counts; kept within (0, count)."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))  # type: ignore[return-value]


class Table:
    """Sorted hashes and their values."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32, copy=False)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are here, the values of those)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=bool), np.zeros(0)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        here = self.hashes[at] == hashes
        return here, self.values[at[here]].astype(np.float64)


class Model:
    """One shard of a model: ln P of the n-grams seen of each order, ln of what a context leaves to the order below."""

    def __init__(self, seen: list[Table], left: list[Table], floor: float):
        self.seen, self.left, self.floor = seen, left, floor

    def surprise(self, line: np.ndarray, places: np.ndarray) -> np.ndarray:
        """-ln P of the character at each place after its ``ORDER - 1`` predecessors."""
        total, live = np.zeros(len(places)), np.arange(len(places))
        for k in range(ORDER, 0, -1):
            here, values = self.seen[k - 1].find(keys(line, places[live], k))
            total[live[here]] -= values
            live = live[~here]
            if not len(live):
                return total
            here, values = self.left[k - 1].find(keys(line, places[live] - 1, k - 1))
            total[live[here]] -= values
        total[live] -= self.floor
        return total
