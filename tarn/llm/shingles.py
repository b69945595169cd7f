"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

WORDS = 5
SLICE = 1 << 18  # bytes whose words are hashed at a time, with some 70 bytes of arrays for each
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + 4096)
        _POWERS[:] = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps))
    return _POWERS[0][:n], _POWERS[1][:n]


def _words_of(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a slice; ``breaks`` are positions where a text begins."""
    blank = _BLANK[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[0] = cut[-1] = True
    cut[breaks] = True
    first = ~blank & (cut[:-1] | np.concatenate([[True], blank[:-1]]))
    last = ~blank & (cut[1:] | np.concatenate([blank[1:], [True]]))
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    # a byte counts by a random number of its value and its place in the word: unlike powers modulo 2^64, whose low bits repeat,
    # these have no words that are known to collide
    place = np.arange(len(data), dtype=np.uint64)
    begin = np.zeros(len(data), dtype=np.int64)
    begin[start] = start
    place -= np.maximum.accumulate(begin).astype(np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(mix((place << np.uint64(8) | data) + np.uint64(_BASE)), out=sums[1:])
    return mix(sums[end] - sums[start] + (end - start).astype(np.uint64)), start


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie end to end in ``data``, and the number of words before each text."""
    hashes, starts, at = [], [], int(offsets[0])
    end = int(offsets[-1])
    while at < end:
        stop = min(at + SLICE, end)
        if stop < end:  # not inside a word: back to a blank or a text's begin, else on to the next
            k = np.searchsorted(offsets, stop, side="right") - 1
            blank = np.flatnonzero(_BLANK[data[max(at, int(offsets[k])):stop]])
            if blank.size:
                stop = max(at, int(offsets[k])) + int(blank[-1]) + 1
            elif int(offsets[k]) > at:
                stop = int(offsets[k])
            else:
                while stop < int(offsets[k + 1]) and not _BLANK[data[stop]]:
                    more = np.flatnonzero(_BLANK[data[stop:min(stop + SLICE, int(offsets[k + 1]))]])
                    stop = stop + int(more[0]) if more.size else min(stop + SLICE, int(offsets[k + 1]))
        inside = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, stop)]
        h, s = _words_of(data[at:stop], inside - at)
        hashes.append(h)
        starts.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS):
    """For each text its set: sorted distinct hashes of ``words`` words in a row, or of all its words if it has fewer."""
    hashes, before = word_hashes(data, offsets)
    many = mix(np.full(len(hashes), words, dtype=np.uint64))[:max(0, len(hashes) - words + 1)]
    for k in range(words):
        many = mix(many * np.uint64(_BASE) + hashes[k:k + len(many)])
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(many[a:b - words + 1])
        elif b > a:
            one = mix(np.array([b - a], dtype=np.uint64))
            for h in hashes[a:b]:
                one = mix(one * np.uint64(_BASE) + h)
            yield one
        else:
            yield hashes[:0]


def arrow_bytes(texts):
    """The UTF-8 bytes of an Arrow string array without nulls, end to end, and the offsets of its texts."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)), at
