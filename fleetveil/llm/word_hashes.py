"""Hashes of all words of an Arrow column of texts, by array operations on its bytes.

A word's hash is the sum over its bytes of two fixed random numbers multiplied, one for the byte
and one for its place in the word, modulo 2^64 and then mixed. ASCII capitals have the number of
their small letter. Words longer than the table of places are hashed one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 22
PLACES = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _numbers(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


_BYTE = _numbers(256, 17)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_PLACE = _numbers(PLACES, 99) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _block(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of some bytes; ``breaks`` are places where texts begin."""
    solid = ~_IS_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    begin[breaks] = solid[breaks]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    letters = data[solid]
    firsts = (np.cumsum(solid) - 1)[starts]
    lengths = np.diff(np.append(firsts, len(letters)))
    places = np.arange(len(letters)) - np.repeat(firsts, lengths)
    hashes = mix(np.add.reduceat(_BYTE[letters] * _PLACE[places & (PLACES - 1)], firsts))
    for i in np.flatnonzero(lengths > PLACES):
        word = letters[firsts[i] : firsts[i] + lengths[i]].tobytes().lower()
        hashes[i] = xxhash.xxh64_intdigest(word)
    return starts, hashes


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    starts, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):  # cut behind white space, further on if a word fills the block
            spaces = np.flatnonzero(_IS_SPACE[data[at:end]])
            while not len(spaces) and end < len(data):
                end = min(end + BLOCK, len(data))
                spaces = np.flatnonzero(_IS_SPACE[data[at:end]])
            if len(spaces) and end < len(data):
                end = at + int(spaces[-1]) + 1
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)]
        s, h = _block(data[at:end], inside - at)
        starts.append(s + at)
        hashes.append(h)
        at = end
    starts = np.concatenate(starts)
    counts = np.diff(np.searchsorted(starts, offsets))
    return np.concatenate(hashes), counts
