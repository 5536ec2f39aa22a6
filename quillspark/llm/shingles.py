"""Word and shingle hashes of whole texts, a batch at a time in numpy.

Words are maximal runs of letters, digits and underscores of the lower-cased text; every non-ASCII
byte counts as a letter. Only about ``SLICE_BYTES`` of text are expanded at once (or one document)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SHINGLE = 5
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0xC4CEB9FE1A85EC53)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_IS_WORD[128:] = True


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX
    h = h ^ (h >> np.uint64(33))
    h = h * _STEP
    return h ^ (h >> np.uint64(33))


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words_by_text(texts: pa.Array) -> Iterator[np.ndarray]:
    """The 64-bit hashes of each text's words, in order; a null text has none."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    if isinstance(lowered, pa.ChunkedArray):
        lowered = lowered.combine_chunks()
    if not len(lowered):
        return
    kind = np.int64 if pa.types.is_large_string(lowered.type) else np.int32
    offsets = np.frombuffer(lowered.buffers()[1], dtype=kind)[lowered.offset : lowered.offset + len(lowered) + 1].astype(np.int64)
    held = lowered.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, dtype=np.uint8)
    for first, last in _slices(offsets):
        base = offsets[first]
        part = data[base : offsets[last]]
        at = np.flatnonzero(_IS_WORD[part])
        if not len(at):
            for _ in range(first, last):
                yield np.zeros(0, dtype=np.uint64)
            continue
        begins = np.empty(len(at), dtype=bool)
        begins[0] = True
        np.not_equal(np.diff(at), 1, out=begins[1:])
        edges = np.searchsorted(at, offsets[first:last] - base)
        begins[edges[edges < len(at)]] = True
        starts = np.flatnonzero(begins)
        place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        hashes = mix64(np.add.reduceat((part[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095], starts))
        cuts = np.searchsorted(starts, np.append(edges, len(at)))
        for i in range(last - first):
            yield hashes[cuts[i] : cuts[i + 1]]


def shingles_of(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``n`` words in order; a shorter text is one shingle of all its words."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        total = total * _STEP + words[i : len(words) - n + 1 + i]
    return mix64(total)
