"""Word and line statistics of a text, one document at a time."""

from __future__ import annotations

import re

import numpy as np

# Fixed value: the characters that count as symbols.
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WHITE = " \t\n\v\f\r"
WINDOW = 8


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found at least twice in the text.

    Windows are compared by a 64-bit hash first; where two agree, exactly.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = hashes[:n].copy()
    for i in range(1, width):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
        rolled += hashes[i : i + n]
    order = np.sort(rolled)
    if not (order[1:] == order[:-1]).any():
        return 0
    # Exact numbers of the words, then of windows of 2, 4, ... words by pairs of numbers.
    numbers: dict[bytes, int] = {}
    rank = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    step = 1
    while step < width:
        rank = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(rank, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); a null text has none."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space
    chars = len(text) - sum(map(text.count, _WHITE))
    lines = [line for line in text.split("\n") if line.strip(_WHITE)]
    return (
        len(words), chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)),
        repeated_words(words),
    )
