"""Hierarchical packing of documents into windows of several lengths.

Every task packs the documents of its partition in pools of a few million tokens, so nothing is
shuffled and memory is bounded by the pool and the longest document. In a pool

1. a document gives as many full longest windows as it can, and its rest is routed to the
   shortest tier that holds it;
2. tiers are packed from the longest down: a window starts with a piece of its own tier, and
   its gap is filled from shorter tiers, largest piece that fits first, the last one cut;
3. what no longer fills a window of its tier is cut down to the shorter tiers, and what does
   not fill a shortest window goes on to the next pool;
4. the windows are dealt to step groups of equal tokens so that attention cost is even.

Every window is full but the last one of a partition. Its length is then no power of two as a
rule, so a trainer pads it to the longest window.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import json

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _byte_letters, vocabulary_path
from .common import documents

TIERS = (128, 256, 512, 1024)
POOL_TOKENS = 2_000_000
STEP_TOKENS = 32_768
SEPARATOR = 0

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
    "offset long, window long, step_group long"
)

# A piece is (length, document, start) with the document's place in the pool.
Piece = tuple[int, int, int]


@lru_cache(2)
def tokenizer(path: str) -> tiktoken.Encoding:
    """The ids of a vocabulary file of the tokenizers library, by a faster library."""
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {
        bytes(letters[c] for c in token): i
        for token, i in spec["model"]["vocab"].items() if token not in special
    }
    return tiktoken.Encoding(
        path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )


class Shelves:
    """Pieces waiting in each tier, ordered by length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.waiting: dict[int, list[Piece]] = {t: [] for t in tiers}

    def put(self, piece: Piece) -> None:
        insort(self.waiting[self.tiers[bisect_left(self.tiers, piece[0])]], piece)

    def fill(self, gap: int, below: int) -> Iterator[Piece]:
        """Pieces from tiers shorter than ``below`` that fill a gap, while there are any."""
        for tier in reversed(self.tiers[: self.tiers.index(below)]):
            shelf = self.waiting[tier]
            while gap and shelf:
                at = bisect_right(shelf, (gap, float("inf"), 0)) - 1
                if at < 0:
                    break
                piece = shelf.pop(at)
                gap -= piece[0]
                yield piece
        if gap:
            yield from self.cut(gap, self.tiers[: self.tiers.index(below)])

    def cut(self, gap: int, tiers: tuple[int, ...]) -> Iterator[Piece]:
        """The head of the shortest waiting piece longer than the gap; its rest waits on."""
        for tier in tiers:
            if self.waiting[tier]:
                length, doc, start = self.waiting[tier].pop()
                yield gap, doc, start
                self.put((length - gap, doc, start + gap))
                return


def pack_pool(lengths: list[int], tiers: tuple[int, ...], last: bool):
    """Windows of a pool, each a list of pieces, and the pieces that filled none."""
    shelves, windows, longest = Shelves(tiers), [], tiers[-1]
    for doc, n in enumerate(lengths):
        full = n - n % longest
        windows += [[(longest, doc, start)] for start in range(0, full, longest)]
        if n > full:
            shelves.put((n - full, doc, full))
    for tier in reversed(tiers):
        shelf = shelves.waiting[tier]
        while shelf:
            window = [shelf.pop()]
            gap = tier - window[0][0]
            if gap:
                window += shelves.fill(gap, tier)
                gap = tier - sum(p[0] for p in window)
            while gap and shelf:  # the shorter tiers are used up: fill from this one
                at = bisect_right(shelf, (gap, float("inf"), 0)) - 1
                piece = shelf.pop(max(at, 0))
                if piece[0] > gap:
                    rest = (piece[0] - gap, piece[1], piece[2] + gap)
                    piece = (gap, *piece[1:])
                    shelves.put(rest)
                    shelf = shelves.waiting[tier]
                window.append(piece)
                gap -= piece[0]
            if not gap:
                windows.append(window)
                continue
            if tier == tiers[0]:
                if last:
                    windows.append(window)
                    return windows, []
                return windows, window
            # One window is left over: whole shorter windows of it, then its rest, go on.
            lower = tiers[tiers.index(tier) - 1]
            for length, doc, start in window:
                while length > lower:
                    shelves.put((lower, doc, start))
                    start, length = start + lower, length - lower
                shelves.put((length, doc, start))
    return windows, []


def step_groups(windows: list[list[Piece]], step_tokens: int) -> list[int]:
    """A group for each window: even in tokens and, by serpentine dealing, in attention cost."""
    tokens = sum(p[0] for w in windows for p in w)
    groups = max(1, round(tokens / step_tokens))
    cost = [(sum(p[0] for p in w), sum(p[0] ** 2 for p in w)) for w in windows]
    out = [0] * len(windows)
    for rank, i in enumerate(sorted(range(len(windows)), key=lambda i: cost[i], reverse=True)):
        turn, place = divmod(rank, groups)
        out[i] = place if turn % 2 == 0 else groups - 1 - place
    return out


class Packer:
    """Packs one partition and numbers its windows and step groups."""

    def __init__(self, partition: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.window = self.group = partition << 40
        self.pool: list[tuple[object, int, int, np.ndarray]] = []
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.pool.append((doc_id, 0, len(ids), ids))
        self.tokens += len(ids)

    def flush(self, last: bool = False) -> pd.DataFrame:
        windows, rest = pack_pool([len(p[3]) for p in self.pool], self.tiers, last)
        groups = step_groups(windows, self.step_tokens) if windows else []
        rows = []
        for window, group in zip(windows, groups):
            offset, width = 0, sum(p[0] for p in window)
            for length, doc, start in window:
                doc_id, base, whole, ids = self.pool[doc]
                rows.append((
                    doc_id, base + start, length, ids[start : start + length].tobytes(), whole,
                    self.window, offset, width if width in self.tiers else self.tiers[-1],
                    self.group + group,
                ))
                offset += length
            self.window += 1
        self.group += max(groups, default=-1) + 1
        carried = [
            (self.pool[d][0], self.pool[d][1] + s, self.pool[d][2], self.pool[d][3][s : s + n].copy())
            for n, d, s in rest
        ]
        self.pool, self.tokens = carried, sum(len(p[3]) for p in carried)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype(
            {"doc_id": "Int64"}
        )


def pack_documents(
    docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS,
    pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its sequence.

    ``ids`` are the piece's tokens (little-endian unsigned 32-bit), ``window`` the tier of its
    sequence, ``step_group`` the training step it is dealt to. A document is its tokens and one
    separator, so that a null or empty text is a piece of one token. Every row counts, repeated
    ones too; a null doc_id stays null. Other columns are ignored; an empty table gives an
    empty result. Sequences and groups never span partitions, so a task that is run again
    replaces all of what it made.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = tokenizer(path)
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        end = np.array([SEPARATOR], np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array(encoding.encode(text or "", allowed_special="all"), np.uint32)
                packer.add(None if pd.isna(doc_id) else int(doc_id), np.concatenate([ids, end]))
                if packer.tokens >= pool_tokens:
                    yield packer.flush()
        if packer.pool:
            yield packer.flush(last=True)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return rows.mapInPandas(pack, SCHEMA)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The packing with production settings, the ids replaced by their checksum."""
    return pack_documents(docs, vocabulary_path()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "window", "step_group",
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(documents(spark, sf_dir))
