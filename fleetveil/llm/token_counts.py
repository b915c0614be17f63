"""Token counts of a sentence-piece BPE model by a compiled finite-state transducer.

Reading one more character changes the number of tokens of the text read so far by an amount
that depends on a bounded context: the longest suffix that still begins some piece, and for each
place in it the last token and the relative count of the encoding that ends there. These
contexts are the states of a deterministic transducer whose transitions carry the change of the
count; they are compiled when first met. An encoding is right if and only if all its adjacent
pairs are, so exactly one last token is possible at each place.

Pieces contain a word mark only at their start, so the mark after another character begins
anew from a known state: a synchronising point. Texts are cut into chunks that are read in
parallel. A chunk's state map is constant behind its first synchronising point, and before it
the map is the short head, applied once the state in front is known. A chunk without such a point
is read from the start state; from another one the map follows both paths until they meet. The
maps are composed by a scan over the chunks in order.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import documents, shuffle_width, text_or_empty

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CHUNK_CHARS = 1 << 16
#: Compiled states and counted words that a worker keeps before it starts afresh. Speed only.
KEPT_STATES, KEPT_WORDS = 200_000, 400_000
TOKEN_LIMIT = 4096

_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_SYNC = re.compile(f"(?<=[^{MARK}]){MARK}")

# suffix that begins a piece; for each place in it (and its end) relative count and last token
State = tuple[str, tuple[tuple[int, str | None], ...]]
START: State = ("", ((0, None),))


class Transducer:
    """Compiled on demand from a sentence-piece BPE model with byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if "".join(model.encode("  ab  c ", out_type=str)) != f"{MARK * 3}ab{MARK * 2}c{MARK}":
            raise ValueError(f"{path}: only models without normalisation are supported")
        self.rank = {
            model.id_to_piece(i): -model.get_score(i)
            for i in range(model.vocab_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        }
        if any(MARK in piece.lstrip(MARK) for piece in self.rank):
            raise ValueError(f"{path}: a piece crosses words")
        # Pieces that merging really makes of their own text.
        self.pieces = {p for p in self.rank if self._merge(p) == [p]}
        self.begins = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        self.known: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the compiled states; they are compiled again when met."""
        self.states, self.numbers = [START], {START: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.words: dict[str, int] = _Words(self)

    def _merge(self, text: str) -> list[str]:
        """BPE by definition, for the few characters of a piece or a pair of pieces."""
        parts = list(text)
        while True:
            ranks = [self.rank.get(a + b, float("inf")) for a, b in zip(parts, parts[1:])]
            best = min(ranks, default=float("inf"))
            if best == float("inf"):
                return parts
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def allows(self, left: str | None, right: str) -> bool:
        if left is None:
            return True
        known = self.known.get((left, right))
        if known is None:
            if len(self.known) >= 500_000:
                self.known.clear()
            known = self.known[left, right] = self._merge(left + right) == [left, right]
        return known

    def number(self, state: State) -> int:
        at = self.numbers.get(state)
        if at is None:
            at = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return at

    def _compile(self, at: int, char: str) -> tuple[int, int]:
        """The transition from a state on a character: next state and change of the count."""
        suffix, places = self.states[at]
        now = suffix + char
        while now and now not in self.begins:
            now = now[1:]
        for cut in range(len(now)):
            token = now[cut:]
            count, last = places[len(places) - len(token)]
            if token in self.pieces and self.allows(last, token):
                change = count + 1
                break
        else:  # no piece: its bytes, or as one symbol if a longer piece holds it
            token = char
            change = places[-1][0] + (1 if char in self.rank else len(char.encode()))
        kept = places[len(places) - len(now):] if now else ()
        moved = tuple((c - change, t) for c, t in kept) + ((0, token),)
        move = self.moves[at][char] = (self.number((now, moved)), change)
        return move

    def run(self, at: int, text: str) -> tuple[int, int]:
        """State and count after reading ``text`` from a state."""
        moves, total = self.moves, 0
        for char in text:
            move = moves[at].get(char) or self._compile(at, char)
            at, total = move[0], total + move[1]
        return at, total

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if len(self.states) > KEPT_STATES:
            self.reset()
        if "  " in text or text[0] == " " or MARK in text:
            marked = MARK + text.replace(" ", MARK)
            return sum(self.run(0, s)[1] for s in _SEGMENT.findall(marked))
        return sum(map(self.words.__getitem__, text.split(" ")))

    def chunk(self, text: str, first: bool, last: bool = False) -> tuple[str, bool, int, bytes | None]:
        """(head, synchronises, tokens behind the head, packed state at the end).

        A chunk without a synchronising point is all head; count and state are then those of
        reading it from the start state, see ``through``.
        """
        if first and last:
            return "", True, self.count(text), None
        if len(self.states) > KEPT_STATES:
            self.reset()
        marked = text.replace(" ", MARK)
        if first:
            marked, start = (MARK + marked if marked else ""), 0
        else:
            found = _SYNC.search(marked)
            if found is None:
                at, total = self.run(0, marked)
                return marked, False, total, pickle.dumps(self.states[at])
            start = found.start()
        end = len(marked)
        while True:  # the last mark behind another character, or the start
            end = marked.rfind(MARK, start, end)
            if end <= start or marked[end - 1] != MARK:
                break
        end = max(end, start)
        total = self.count(marked[start + 1 : end].replace(MARK, " ")) if end > start else 0
        at, more = self.run(0, marked[end:])
        return marked[:start], True, total + more, pickle.dumps(self.states[at])

    def resume(self, state: bytes, text: str) -> int:
        """Tokens that a head adds behind the state in front of it."""
        return self.run(self.number(pickle.loads(state)), text)[1]

    def through(self, state: bytes, text: str, total: int, end: bytes) -> tuple[int, bytes]:
        """Tokens and end state of a chunk read from ``state``, given those from the start state.

        Both paths are followed only until they meet, which they do within a few tokens unless
        the text is periodic.
        """
        if len(self.states) > KEPT_STATES:
            self.reset()
        at, other, own, guessed = self.number(pickle.loads(state)), 0, 0, 0
        for char in text:
            if at == other:
                return own + total - guessed, end
            (at, n), (other, m) = self.run(at, char), self.run(other, char)
            own, guessed = own + n, guessed + m
        return own, pickle.dumps(self.states[at])


class _Words(dict):
    """Counts of words behind a mark: whole paths through the transducer."""

    def __init__(self, owner: Transducer):
        self.owner = owner

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        total = self.owner.run(0, MARK + word)[1]
        if len(word) < 64:
            self[word] = total
        return total


@lru_cache(2)
def load(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(
    docs: DataFrame, path: str, limit: int = TOKEN_LIMIT, chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, whole texts.

    A null text counts as empty and has no tokens; repeated rows and ids give repeated rows;
    other columns are ignored; an empty table gives an empty result. Long texts are spread
    over tasks by chunks, whose maps are composed in order, one chunk in memory at a time.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text")
    )
    last = F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / chunk_chars).cast("int")
    chunks = rows.select(
        "row", "doc_id", "text", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("k")
    ).select(
        "row", "doc_id", "k", "last",
        F.when(F.col("last") == 0, F.col("text")).otherwise(
            F.substring("text", F.col("k") * chunk_chars + 1, F.lit(chunk_chars))
        ).alias("chunk"),
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transducer = load(path)
        for batch in batches:
            maps = [
                transducer.chunk(c, k == 0, k == end)
                for c, k, end in zip(batch["chunk"], batch["k"], batch["last"])
            ]
            out = batch[["row", "doc_id", "k"]].copy()
            out["n_bytes"] = [len(c.encode()) for c in batch["chunk"]]
            out["head"], out["synced"], out["inner"], out["state"] = (
                list(x) for x in (zip(*maps) if maps else ((), (), (), ()))
            )
            yield out

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Chunks of a text follow each other: the running state goes from one to the next."""
        transducer = load(path)
        row = doc_id = state = None
        n_bytes = n_tokens = 0
        for batch in batches:
            done = []
            for r in batch.itertuples(index=False):
                if r.row != row:
                    if row is not None:
                        done.append((doc_id, n_bytes, n_tokens))
                    row, doc_id, state, n_bytes, n_tokens = r.row, r.doc_id, None, 0, 0
                n_bytes += r.n_bytes
                if r.synced:
                    n_tokens += r.inner + (transducer.resume(state, r.head) if r.head else 0)
                    state = r.state
                else:
                    n, state = transducer.through(state, r.head, r.inner, r.state)
                    n_tokens += n
            yield pd.DataFrame(done, columns=["doc_id", "n_bytes", "n_tokens"]).astype(kinds)
        if row is not None:
            yield pd.DataFrame([(doc_id, n_bytes, n_tokens)], columns=["doc_id", "n_bytes", "n_tokens"]).astype(kinds)

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = {"doc_id": "Int64"} if doc_type in ("bigint", "int") else {}
    maps = chunks.mapInPandas(
        read,
        f"row long, doc_id {doc_type}, k int, n_bytes long, head string, synced boolean, "
        "inner long, state binary",
    )
    ordered = maps.repartition(shuffle_width(docs.sparkSession), "row").sortWithinPartitions("row", "k")
    total = ordered.mapInPandas(compose, f"doc_id {doc_type}, n_bytes long, n_tokens long")
    return total.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), vocabulary_path(MODEL))
