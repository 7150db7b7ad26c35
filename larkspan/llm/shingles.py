"""Word shingles of UTF-8 text in Arrow batches, and their fast similarity sketch, in numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lower-cased and every other byte kept, so no text is decoded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled in one go; a longer text is handled alone.
CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


_BYTE = seeds(256, 11)
_BYTE[np.arange(65, 91)] = _BYTE[np.arange(97, 123)]
_BYTE[_SPACE] = 0
_BASE = 0x5851F42D4C957F2D
_pow = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _pow
    while len(_pow) < n:
        _pow = np.concatenate([_pow, _pow * np.uint64(pow(_BASE, len(_pow), 1 << 64))])
    return _pow


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts data[offs[i]:offs[i + 1]], and the words' text numbers."""
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    start[heads] = ~space[heads]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # from one word's start to the next one's; the spaces in between count as 0
    spans = np.diff(at, append=len(data))
    local = np.arange(at[0], len(data)) - np.repeat(at, spans)
    value = _BYTE[data[at[0] :]] * _powers(int(spans.max()))[local]
    return mix(np.add.reduceat(value, at - at[0])), np.searchsorted(offs, at, "right") - 1


def shingle_sets(texts: pa.Array, k: int):
    """For each text the sorted distinct hashes of its k-word shingles, uint64.

    Fewer than k words: the whole sequence is the one shingle. No words: empty.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    mult = seeds(k, 23)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + CHUNK, "right")) - 1)
        own = offs[first : last + 1] - offs[first]
        words, text = word_hashes(data[offs[first] : offs[last]], own)
        cuts = np.searchsorted(text, np.arange(last - first + 1))
        grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k if len(grams) else 0):
            grams += words[j : j + len(grams)] * mult[j]
        grams = mix(grams)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield mix((words[a:b] * mult[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
        first = last


def fast_similarity_sketch(sets: list[np.ndarray], t: int, salt: int = 5) -> np.ndarray:
    """A row of t coordinates for each set, by fast similarity sketching.

    In round i < t each element goes to a hashed bin with value i plus a
    fraction, and a bin keeps its least value; in round i >= t all elements go
    to bin i - t. A set stops after the round that filled its last bin. All
    sets of a batch take their rounds together.
    """
    out = np.full(len(sets) * t, _FULL, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    elems = np.concatenate([*sets, np.zeros(0, np.uint64)])
    row = np.repeat(np.arange(len(sets)), sizes)
    seed = seeds(2 * t, salt)
    for i in range(2 * t):
        if not len(elems):
            break
        x = mix(elems ^ seed[i])
        bins = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(out, row * t + bins, (x & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32))
        open_ = (out.reshape(-1, t) == _FULL).any(1)
        keep = open_[row]
        elems, row = elems[keep], row[keep]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hashed key for each band of `rows` coordinates."""
    grouped = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    return mix((grouped * seeds(rows, 31)).sum(2) + seeds(bands, 37))
