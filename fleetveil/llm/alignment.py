"""Alignment of two tokenizers' tokens by the bytes that they cover.

The ends of a document's A and B tokens are two sorted rows of byte offsets. Merging them gives
everything: between two neighbouring ends one A and one B token overlap, and an end in both
rows closes a group. The merge is cut by merge path: on the diagonals that split its steps into equal
parts a binary search finds how many steps come from either row, so a long document becomes
independent pieces of equal work. Each piece emits its overlaps; what is open at its borders is
stitched into groups by a running count of the groups closed so far.

How often two ids overlap is counted over all documents. The most frequent pairs, bounded in number,
go to the workers as a table; the counts of all others are joined.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import VOCABULARY, vocabulary_path
from .common import documents, drop_stored, shuffle_width, stored
from .packing import tokenizer as byte_bpe
from .token_counts import MARK, MODEL

#: Steps of the merge in one piece.
PIECE_STEPS = 1 << 15
#: Pairs of ids whose counts are sent to every worker: at most 16 bytes each.
TABLE_PAIRS = 1 << 19
#: Different pairs that a task counts before it passes them on.
COUNTED_PAIRS = 1 << 20


class Tokenizers:
    """Both tokenizers, and the bytes that each of their tokens covers."""

    def __init__(self, path_a: str, path_b: str):
        self.a = byte_bpe(path_a)
        bytes_a = [b""] * self.a.n_vocab
        for token in self.a.token_byte_values():
            bytes_a[self.a.encode_single_token(token)] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            byte = self.b.is_byte(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if byte else piece.replace(MARK, " ").encode())
        self.bytes_a, self.size_b = bytes_a, len(self.bytes_b)
        self.lengths_a = np.array([len(x) for x in bytes_a])
        self.lengths_b = np.array([len(x) for x in self.bytes_b])

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of blank and text by A and of the text by B; None if there are no tokens."""
        if not text:
            return None
        whole = " " + text
        a = self.a.encode_to_numpy(whole, disallowed_special=())
        b = self.b.encode(text, num_threads=1)
        content = whole.encode()
        # A's tokens are stretches of the text's bytes in order: they are all of it if as long.
        if self.lengths_a[a].sum() != len(content):
            return None
        if b"".join(map(self.bytes_b.__getitem__, b)) != content:
            return None
        return a, np.frombuffer(array("I", b), np.uint32)


@lru_cache(2)
def load(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def merge_path(a: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """How many of ``a`` are among the first 0, steps, 2 steps ... of the merge, then all.

    On equal values ``a`` goes first. All diagonals are searched at once.
    """
    diagonals = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b))
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        # Where a[middle] belongs before b[diagonal - middle - 1], more of a is needed.
        other = np.where(open_, diagonals - middle - 1, 0)
        more = open_ & (a[np.where(open_, middle, 0)] <= b[other])
        low, high = np.where(more, middle + 1, low), np.where(open_ & ~more, middle, high)
    return low


def token_pieces(
    docs: DataFrame, path_a: str, path_b: str, steps: int = PIECE_STEPS
) -> DataFrame:
    """(row, doc_id, piece, pieces, a, b, own_a, own_b, at_a, at_b): the tokens of every row.

    ``a`` and ``b`` are ids (little-endian uint32) of a piece of the merge: its own, and the
    next token of either kind, if any, which is open at its end. ``at_a`` and ``at_b`` are the
    byte offsets where they begin. A row without tokens is one empty piece.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(path_a, path_b)
        for batch in batches:
            out, held = [], 0
            ids = batch.column("doc_id")
            for k, text in enumerate(batch.column("text")):
                coded = both.encode(text.as_py())
                if coded is None:
                    out.append((k, 0, 1, b"", b"", 0, 0, 0, 0))
                    continue
                a, b = coded
                ends_a, ends_b = np.cumsum(both.lengths_a[a]), np.cumsum(both.lengths_b[b])
                i = merge_path(ends_a, ends_b, steps)
                j = np.minimum(np.arange(len(i)) * steps, len(a) + len(b)) - i
                for p in range(len(i) - 1):
                    out.append((
                        k, p, len(i) - 1, a[i[p] : i[p + 1] + 1].tobytes(), b[j[p] : j[p + 1] + 1].tobytes(),
                        i[p + 1] - i[p], j[p + 1] - j[p],
                        ends_a[i[p] - 1] if i[p] else 0, ends_b[j[p] - 1] if j[p] else 0,
                    ))
                held += 4 * (len(a) + len(b))
                if held > 1 << 23:
                    yield _pieces_batch(out, batch, ids)
                    out, held = [], 0
            if out:
                yield _pieces_batch(out, batch, ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        cut,
        f"row long, doc_id {kind}, piece int, pieces int, a binary, b binary, own_a int, own_b int, "
        "at_a long, at_b long",
    )


def _pieces_batch(out: list[tuple], batch: pa.RecordBatch, ids: pa.Array) -> pa.RecordBatch:
    columns = list(zip(*out))
    of = pa.array(columns[0], pa.int64())
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [batch.column("row").take(of), ids.take(of)]
        + [pa.array(c, t) for c, t in zip(columns[1:], kinds)],
        names=["row", "doc_id", "piece", "pieces", "a", "b", "own_a", "own_b", "at_a", "at_b"],
    )


class Aligner:
    """Merges one piece at a time."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.size = max(len(both.lengths_a), len(both.lengths_b))
        self.written = np.array([s + str(i) for s in ",;|" for i in range(self.size)], object)

    def render(self, a: np.ndarray, groups_a: np.ndarray, b: np.ndarray, groups_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2`` of tokens with the numbers of their groups, both ascending."""
        groups = max([int(g[-1]) + 1 for g in (groups_a, groups_b) if len(g)], default=0)
        n_a, n_b = np.bincount(groups_a, minlength=groups), np.bincount(groups_b, minlength=groups)
        # A group's A tokens come behind the B tokens of the groups before, its B tokens behind them.
        at_a = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[groups_a]
        at_b = np.arange(len(b)) + np.cumsum(n_a)[groups_b]
        out = np.empty(len(a) + len(b), np.int64)
        out[at_a] = a + self.size * (np.diff(groups_a, prepend=-1) > 0)
        out[at_b] = b + 2 * self.size * (np.diff(groups_b, prepend=-1) > 0)
        return "".join(self.written[out].tolist())[1:]

    def merge(self, a, b, own_a: int, own_b: int, at_a: int, at_b: int) -> tuple:
        """(links, groups closed, a and b of each, places of the group ends among them)."""
        # Places are counted from where the piece begins; every token has a byte at least.
        begin = min(at_a, at_b)
        at_a, at_b = at_a - begin, at_b - begin
        ends_a = at_a + np.cumsum(self.both.lengths_a[a])
        ends_b = at_b + np.cumsum(self.both.lengths_b[b])
        # Equal ends on a border: the piece before, which has the A token, has closed the group.
        skip = int(own_b > 0 and ends_b[0] == at_a)
        tie = int(own_a > 0 and own_b < len(b) and ends_b[own_b] == ends_a[own_a - 1])
        places = 1 + int(max(*ends_a[-1:], *ends_b[-1:], 0, 0))
        in_a = np.bincount(ends_a[:own_a], minlength=places)
        in_b = np.bincount(ends_b[skip:own_b], minlength=places)
        ends = np.flatnonzero(in_a + in_b)
        # Of each end, how many tokens have ended before it.
        of_a, of_b = (np.cumsum(in_a) - in_a)[ends], skip + (np.cumsum(in_b) - in_b)[ends]
        links = a[of_a].astype(np.uint64) * np.uint64(self.both.size_b) + b[of_b]
        shut = (ends_a[of_a] == ends) & (ends_b[of_b] == ends)
        is_shut = np.bincount(ends[shut], minlength=places)
        before = np.cumsum(is_shut) - is_shut
        groups_a, groups_b = before[ends_a[:own_a]], before[ends_b[skip : own_b + tie]]
        return links, int(shut.sum()), (a[:own_a], groups_a), (b[skip : own_b + tie], groups_b)

    def row(self, whole: bool, *piece) -> tuple:
        """(n_groups, links, body, head_a, head_b, tail_a, tail_b) of a piece."""
        links, closed, (a, groups_a), (b, groups_b) = self.merge(*piece)
        packed = links.astype("<u4" if self.size * self.both.size_b < 1 << 32 else "<u8").tobytes()
        if whole:
            return closed, packed, self.render(a, groups_a, b, groups_b), None, None, None, None
        edges_a, edges_b = (np.searchsorted(g, [1, max(closed, 1)]) for g in (groups_a, groups_b))
        ids = lambda x: ",".join(map(str, x.tolist()))
        body = self.render(
            a[slice(*edges_a)], groups_a[slice(*edges_a)], b[slice(*edges_b)], groups_b[slice(*edges_b)]
        )
        return (
            closed, packed, body, ids(a[: edges_a[0]]), ids(b[: edges_b[0]]),
            ids(a[edges_a[1] :]), ids(b[edges_b[1] :]),
        )


_ALIGNED = (
    "n_a long, n_b long, n_groups long, n_links long, links binary, body string, head_a string, "
    "head_b string, tail_a string, tail_b string"
)


def _aligned(pieces: DataFrame, path_a: str, path_b: str) -> DataFrame:
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(load(path_a, path_b))
        texts = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.string()] * 5]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out = []
                tokens = [[np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(c)] for c in "ab"]
                places = [batch.column(c).to_pylist() for c in ("own_a", "own_b", "at_a", "at_b")]
                for pieces_of, a, b, *place in zip(batch.column("pieces").to_pylist(), *tokens, *places):
                    made = aligner.row(pieces_of == 1, a, b, *place)
                    step = len(made[1]) // (4 if aligner.size * aligner.both.size_b < 1 << 32 else 8)
                    out.append((place[0], place[1], made[0], step, *made[1:]))
                columns = list(zip(*out)) or [()] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("row", "doc_id", "piece", "pieces")]
                    + [pa.array(c, t) for c, t in zip(columns, texts)],
                    names=["row", "doc_id", "piece", "pieces", *(c.split()[0] for c in _ALIGNED.split(", "))],
                )

    return pieces.mapInArrow(align, f"row long, doc_id {kind}, piece int, pieces int, {_ALIGNED}")


def align_pieces(pieces: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Overlaps of documents that are one piece, and of the pieces of all longer ones.

    The latter are dealt out anew, so that a long document is not the work of one task.
    """
    long = pieces.where("pieces > 1").repartition(shuffle_width(pieces.sparkSession), "row", "piece")
    return (
        _aligned(pieces.where("pieces = 1"), path_a, path_b), _aligned(long, path_a, path_b)
    )


def stitched(pieces: DataFrame) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups) of documents in several pieces.

    The groups closed before a piece number its first, open one; parts of one group meet by
    that number.
    """
    before = F.sum("n_groups").over(Window.partitionBy("row").orderBy("piece")) - F.col("n_groups")
    counted = pieces.drop("links").withColumn("before", before)

    def part(number: Column, order: int, a: Column, b: Column, body: Column) -> Column:
        return F.struct(number.alias("number"), F.lit(order).alias("side"), a.alias("a"), b.alias("b"), body.alias("body"))

    none = F.lit(None).cast("string")
    n = F.col("n_groups")
    parts = F.array(
        part(F.col("before"), 0, F.col("head_a"), F.col("head_b"), none),
        F.when(n > 1, part(F.col("before") + 1, 0, none, none, F.col("body"))),
        F.when(n > 0, part(F.col("before") + n, 1, F.col("tail_a"), F.col("tail_b"), none)),
    )
    spread = counted.select("row", "piece", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p"))
    ordered = F.array_sort(F.collect_list(F.struct("piece", "p.side", "p.a", "p.b")))
    whole = spread.groupBy("row", F.col("p.number").alias("number")).agg(
        F.max("p.body").alias("body"), ordered.alias("parts")
    )
    side = lambda name: F.array_join(
        F.filter(F.transform("parts", lambda p: p[name]), lambda x: x != ""), ","
    )
    text = F.coalesce("body", F.concat(side("a"), F.lit("|"), side("b")))
    # Behind the last group nothing is left, so that one part is empty on both sides.
    groups = whole.select("row", "number", text.alias("text")).where("text != '|'").groupBy("row").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda g: g["text"]), ";"
        ).alias("groups")
    )
    sums = counted.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
    )
    return sums.join(groups, "row")


class Alignment:
    """Tokens of all documents aligned: ``documents``, ``links`` by row and counts of pairs.

    Null and empty texts, and those that either tokenizer gives back as other text, have no
    tokens: all counts are 0, ``groups`` is empty. Repeated rows and ids count as rows of their own, other
    columns are ignored, an empty table gives empty results. A whole text is encoded by one task.
    """

    def __init__(
        self, docs: DataFrame, path_a: str, path_b: str, steps: int = PIECE_STEPS,
        groups: Column | None = None,
    ):
        """``groups``: what is kept of the column ``groups`` of the documents, by default all."""
        self.spark = docs.sparkSession
        self.size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.code = "<u4" if max(most + 1, self.size_b) * self.size_b < 1 << 32 else "<u8"
        kept = (F.col("groups") if groups is None else groups).alias("groups")
        pieces = stored(token_pieces(docs, path_a, path_b, steps), "align-tokens")
        one, many = align_pieces(pieces, path_a, path_b)
        numbers = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links"]
        one = stored(
            one.withColumnRenamed("body", "groups").select(*numbers, kept, "links"), "align-links"
        )
        many = stored(many, "align-pieces")
        drop_stored(pieces)
        whole = stored(stitched(many).select(*numbers, kept), "align-long")
        self.links = one.select("row", "links").unionByName(many.select("row", "links"))
        self.documents = one.select(*numbers, "groups").unionByName(whole)
        self.counts = stored(self._counts(), "align-counts")

    def _counts(self) -> DataFrame:
        """(pair, n, best): pair is A's id times the size of B's vocabulary, plus B's id."""
        code = self.code

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, sums = np.empty(0, code), np.empty(0, np.int64)
            held, size = [], 0
            for batch in batches:
                for links in batch.column("links"):
                    held.append(np.frombuffer(links.as_buffer(), code))
                    size += len(held[-1])
                    if size > COUNTED_PAIRS:
                        keys, sums = _added(keys, sums, np.concatenate(held))
                        held, size = [], 0
                        if len(keys) > COUNTED_PAIRS:
                            yield _counted(keys, sums)
                            keys, sums = keys[:0], sums[:0]
            if held:
                keys, sums = _added(keys, sums, np.concatenate(held))
            yield _counted(keys, sums)

        total = self.links.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(
            F.sum("n").alias("n")
        )
        total = stored(total, "align-sums")
        by_b = total.groupBy((F.col("pair") % self.size_b).alias("b")).agg(F.max("n").alias("most"))
        # One row for each id of B's vocabulary at most.
        both = total.withColumn("b", F.col("pair") % self.size_b).join(F.broadcast(by_b), "b")
        return both.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))

    def _frequent(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs with the largest counts, at most so many, their counts and whether best."""
        level = F.floor(F.log2("n")).cast("int")
        sizes = dict(self.counts.groupBy(level.alias("level")).count().collect())
        least, total = 64, 0
        for x in sorted(sizes, reverse=True):
            total += sizes[x]
            if total > most:
                break
            least = x
        table = self.counts.where(level >= least).toArrow()
        pairs = table["pair"].to_numpy()
        order = np.argsort(pairs)
        return pairs[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order]

    def scores(self, table_pairs: int = TABLE_PAIRS) -> DataFrame:
        """(row, n_best, count_sum) of every row that has links.

        n_best is how many links have the largest count of their B id, count_sum the counts'
        sum. The table of frequent pairs changes the work alone: all others are joined.
        """
        shared = self.spark.sparkContext.broadcast(self._frequent(table_pairs))
        code = self.code

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs, counts, best = shared.value
            for batch in batches:
                rows, keys_out, times, sums, bests = [], [], [], [], []
                for row, links in zip(batch.column("row").to_pylist(), batch.column("links")):
                    keys = np.frombuffer(links.as_buffer(), code).astype(np.int64)
                    at = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
                    known = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
                    rows.append([row])
                    keys_out.append([-1])
                    times.append([0])
                    sums.append([int(counts[at[known]].sum())])
                    bests.append([int(best[at[known]].sum())])
                    if not known.all():
                        rest, n = np.unique(keys[~known], return_counts=True)
                        rows.append(np.full(len(rest), row))
                        keys_out.append(rest)
                        times.append(n)
                        sums.append(np.zeros(len(rest), np.int64))
                        bests.append(np.zeros(len(rest), np.int64))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c), pa.int64()) for c in (rows, keys_out, times, sums, bests)],
                        names=["row", "pair", "times", "count_sum", "n_best"],
                    )

        found = stored(
            self.links.mapInArrow(look_up, "row long, pair long, times long, count_sum long, n_best long"),
            "align-found",
        )
        rest = found.where("pair >= 0").select("row", "pair", "times").join(self.counts, "pair").select(
            "row", (F.col("times") * F.col("n")).alias("count_sum"),
            F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"),
        )
        return found.where("pair < 0").select("row", "count_sum", "n_best").unionByName(rest).groupBy(
            "row"
        ).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _added(keys: np.ndarray, sums: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, ascending, with one more for each occurrence in ``more``."""
    more = np.sort(more)
    starts = np.flatnonzero(np.diff(more, prepend=more[:1] + 1) != 0)
    joined = np.concatenate([keys, more[starts]])
    n = np.concatenate([sums, np.diff(starts, append=len(more))])
    order = np.argsort(joined, kind="stable")
    joined, n = joined[order], n[order]
    firsts = np.flatnonzero(np.diff(joined, prepend=joined[:1] + 1) != 0)
    return joined[firsts], np.add.reduceat(n, firsts) if len(firsts) else n


def _counted(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.astype(np.int64)), pa.array(n)], names=["pair", "n"]
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = Alignment(
        documents(spark, sf_dir), vocabulary_path(VOCABULARY), vocabulary_path(MODEL), groups=digest
    )
    return aligned.documents.join(aligned.scores(), "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.col("groups").alias("groups_sha256"),
    )
