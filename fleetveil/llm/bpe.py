"""Exact byte-level BPE without replaying merges: a backtracking encoder, a table decoder.

A sequence of vocabulary tokens is the BPE encoding of its text if and only if every adjacent
pair is compatible, that is, if BPE would give the two tokens back for their joined text. So
the encoder takes the longest token at a position (an Aho-Corasick automaton finds all matches
of a piece of text in one pass), checks it against the token before it, and on a conflict tries
the next shorter match or steps back one token. A position from which no valid continuation
exists is marked and never entered again, which bounds the work by the text's length.
"""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
import re
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .common import documents, text_or_empty

VOCABULARY = "byte_bpe_50k.json"
#: Encoded pieces that a worker remembers; when full it starts afresh. Speed only.
REMEMBERED = 1_000_000

# Fixed value: the published split of byte-level BPE.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# White space other than blank and line feed: such texts are split as a whole.
_OTHER_SPACE = re.compile(
    "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]"
)
# Marks that stand alone after a word.
_CLOSING = frozenset(".,;:!?)")
_RUN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Which two tokens may stand side by side, for merges that each make one token.

    ``parts[t]`` are the two tokens that were merged into ``t`` (``t`` twice for a single
    byte), ``order[t]`` when: lower merges come first, bytes before all.
    """

    def __init__(self, merged: dict[tuple[int, int], int], parts: list, order: list[int]):
        self.merged, self.parts, self.order = merged, parts, order
        self.known: dict[tuple[int, int], bool] = {}

    def allows(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.known.get(pair)
        if known is None:
            if len(self.known) >= 1_000_000:
                self.known.clear()
            known = self.known[pair] = self._allows(left, right)
        return known

    def _allows(self, left: int, right: int) -> bool:
        """Undo the latest merges beside the border one by one, newest first.

        At each step the border pair existed until the undone merge (``until``); if the pair
        itself merges before that, BPE would have joined it and the tokens cannot both stand.
        On equal rank the leftmost place merges first, hence the half step on the right.
        """
        merged, parts, order = self.merged, self.parts, self.order
        until = float("inf")
        while True:
            joined = merged.get((left, right))
            if joined is not None and order[joined] < until:
                return False
            a, b = order[left], order[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                until, left = a, parts[left][1]
            else:
                until, right = b + 0.5, parts[right][0]


class ByteBpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        content: dict[int, bytes] = {
            i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if t not in self.special
        }
        content |= {i: t.encode() for t, i in self.special.items()}
        size = max(content) + 1
        order, parts = [-1] * size, [(i, i) for i in range(size)]
        merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocabulary[a + b]
            merged[vocabulary[a], vocabulary[b]] = made
            if order[made] < 0:
                order[made], parts[made] = rank, (vocabulary[a], vocabulary[b])
        self.pairs = PairTable(merged, parts, order)
        ordinary = {b: i for i, b in content.items() if i not in self.special.values()}
        self.ids = {i: np.uint32(i).tobytes() for i in content}
        self.whole = {b: self.ids[i] for b, i in ordinary.items()}
        # Matches are sought from the right, so that those with one start come together; each
        # token brings along the shorter tokens that it begins with, longest first.
        self.matches = ahocorasick.Automaton()
        for b, i in ordinary.items():
            starts = [b[:k] for k in range(len(b), 0, -1)]
            chain = tuple((len(t), ordinary[t]) for t in starts if t in ordinary)
            self.matches.add_word(b[::-1].decode("latin-1"), chain)
        self.matches.make_automaton()
        self.specials = (
            regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
            if self.special else None
        )
        self.offsets = np.zeros(size + 1, np.int64)
        self.offsets[1:] = np.cumsum([len(content.get(i, b"")) for i in range(size)])
        self.bytes = np.frombuffer(b"".join(content.get(i, b"") for i in range(size)), np.uint8)
        self.first, self.later = _Pieces(self, ""), _Pieces(self, " ")

    def encode_piece(self, piece: bytes) -> bytes:
        """Ids, as little-endian uint32, of a piece that no token crosses."""
        known = self.whole.get(piece)
        if known is not None:
            return known
        n = len(piece)
        found = list(self.matches.iter(piece[::-1].decode("latin-1")))
        found.reverse()
        longest = dict(found)  # of one place the longest match was reported first
        known, check = self.pairs.known, self.pairs.allows
        closed: set[int] = set()
        at, last, k = 0, -1, 0
        taken: list[tuple[int, int, int]] = []
        while at < n:
            for length, token in longest[n - 1 - at][k:]:
                if at + length in closed:
                    k += 1
                    continue
                fits = True if last < 0 else known.get((last, token))
                if fits or fits is None and check(last, token):
                    taken.append((at, token, k))
                    at, last, k = at + length, token, 0
                    break
                k += 1
            else:
                closed.add(at)
                at, _, k = taken.pop()
                k += 1
                last = taken[-1][1] if taken else -1
        ids = self.ids
        return b"".join([ids[t] for _, t, _ in taken])

    def _ordinary(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        No token crosses from a letter to the blank behind it, so pieces between blanks are
        encoded on their own; runs of mixed white space are kept together.
        """
        if not text:
            return b""
        if _OTHER_SPACE.search(text):
            return b"".join([self.encode_piece(p.encode()) for p in SPLIT.findall(text)])
        if "  " in text or "\n " in text or text[0] == " ":
            return b"".join(map(self.first.__getitem__, _RUN.findall(text)))
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if self.specials is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        return b"".join(
            self.ids[self.special[part]] if i % 2 else self._ordinary(part)
            for i, part in enumerate(self.specials.split(text))
        )

    def decode(self, ids: bytes) -> str:
        """Text of the ids: every token's bytes are a slice given by the offset table."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        starts = self.offsets[tokens]
        lengths = self.offsets[tokens + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
        return self.bytes[where].tobytes().decode("utf-8", "replace")


class _Pieces(dict):
    """Remembers the ids of pieces of text."""

    def __init__(self, owner: ByteBpe, before: str):
        self.owner, self.before = owner, before

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        encode = self.owner.encode_piece
        if piece.isalpha():
            ids = encode((self.before + piece).encode())
        elif piece[:-1].isalpha() and piece[-1] in _CLOSING:
            return self[piece[:-1]] + encode(piece[-1].encode())
        else:
            ids = b"".join([encode(p.encode()) for p in SPLIT.findall(self.before + piece)])
        if len(piece) < 64:
            self[piece] = ids
        return ids


@lru_cache(2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_ids(text: Column, path: str) -> Column:
    """Ids of each text as little-endian unsigned 32-bit integers in one binary value."""

    @F.pandas_udf(BinaryType())
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(load(path).encode)

    return encode(text)


def token_text(ids: Column, path: str) -> Column:
    """Text of each value made by ``token_ids``; bytes that are no UTF-8 are replaced."""

    @F.pandas_udf(StringType())
    def decode(values: pd.Series) -> pd.Series:
        return values.map(load(path).decode)

    return decode(ids)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_tokens): every row of ``docs``, whole texts, a null text as empty.

    One row in, one row out, no shuffle: repeated rows and ids give repeated rows, an empty
    table an empty one; other columns are ignored.
    """
    encoded = docs.select("doc_id", token_ids(text_or_empty(), path).alias("ids"))
    return encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded): adds the text that the ids stand for."""
    return encoded.withColumn("decoded", token_text(F.col("ids"), path))


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    back = decode_documents(encode_documents(documents(spark, sf_dir), path), path)
    return back.select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
