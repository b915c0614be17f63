"""An interpolated modified Kneser-Ney bigram model, counted in Spark, mapped by workers.

Counting. Each task turns its texts into 64-bit word hashes, sorts the pairs of neighbouring
words and sends each shard one block of distinct pairs with counts. A shard is a range of pair
hashes, so no frequent word or context falls to one task. Shards add up their blocks, write the
pairs as a sorted hash array and pass on what they know of each word: its count, how many
words precede it, and as a context its count and how many words follow once, twice, more often.
A second shuffle adds these up by word, again into sorted arrays.

Scoring. A worker maps the arrays of the shared folder into memory, read-only, sorts the pairs of
a batch of texts and looks them up by binary search. Where the shared folder is no mounted path,
a worker copies an array once into a temporary file that is unlinked while it is mapped.

Two texts with one 64-bit hash would share counts; at 10^9 distinct pairs that is one pair in
about forty such corpora.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold_remainder, new_folder, shuffle_width, text_or_empty

#: Tokens of texts that a task holds as hashes at a time.
BATCH_TOKENS = 2_000_000
HELD_OUT_PARTS, HELD_OUT = 5, 1

# Texts with white space, which no word can be.
END = np.uint64(xxhash.xxh64_intdigest(b"\n end"))
BEGIN = np.uint64(xxhash.xxh64_intdigest(b"\n begin"))

BLOCK = "shard int, payload binary"
STATS = "shard int, payload binary, pairs long, n1 long, n2 long, n3 long, n4 long"
#: Of a word: as a token its count and how many different words precede it; as a context its
#: count and how many different words follow it once, twice, three times or more.
WORD_FIELDS = ["count", "before", "context", "f1", "f2", "f3"]


class _Hashes(dict):
    """Hashes of lower-cased words, remembered for speed."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words (ASCII letters in lower case), then of its end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * np.uint64(0x9E3779B97F4A7C15) + right
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The range of the hash space that each hash lies in."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _contexts(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of some texts in a row, and the token before each."""
    right = np.concatenate(tokens)
    left = np.empty_like(right)
    left[1:] = right[:-1]
    left[np.cumsum([0] + [len(t) for t in tokens[:-1]])] = BEGIN
    return left, right


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join([len(a).to_bytes(8, "little") + a.tobytes() for a in arrays])


def unpack(payload: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(payload[at : at + 8], "little")
        out.append(np.frombuffer(payload, kind, n, at + 8))
        at += 8 + out[-1].nbytes
    return out


def _pair_blocks(tokens: list[np.ndarray], shards: int) -> Iterator[tuple[int, bytes]]:
    """Distinct pairs with counts of some texts, one block for each shard.

    In a block the pairs are grouped by left word, which is then written once.
    """
    left, right = _contexts(tokens)
    keys, where, counts = np.unique(pair_hashes(left, right), return_index=True, return_counts=True)
    left, right, shard = left[where], right[where], shard_of(keys, shards)
    edges = np.searchsorted(shard, np.arange(shards + 1))
    for s in range(shards):
        a, b = edges[s], edges[s + 1]
        if a < b:
            order = np.argsort(left[a:b], kind="stable")
            words, sizes = np.unique(left[a:b][order], return_counts=True)
            yield s, pack(
                words, sizes.astype(np.uint32), right[a:b][order],
                counts[a:b][order].astype(np.uint32),
            )


def _sum_by(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    return keys[first], [np.add.reduceat(v[order], first) if len(first) else v for v in values]


def _merge_pairs(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pair hash, left, right and total count of a shard, sorted by pair hash."""
    lefts, rights, counts = [], [], []
    for payload in payloads:
        words, sizes, right, count = unpack(payload, "<u8", "<u4", "<u8", "<u4")
        lefts.append(np.repeat(words, sizes))
        rights.append(right)
        counts.append(count.astype(np.uint64))
    left, right, count = map(np.concatenate, (lefts, rights, counts))
    keys = pair_hashes(left, right)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    at = order[first]
    return keys[first], left[at], right[at], np.add.reduceat(count[order], first)


def _word_facts(left: np.ndarray, right: np.ndarray, count: np.ndarray):
    """What a shard's pairs say of each word, in the order of WORD_FIELDS."""
    zero, one = np.zeros(len(count), np.uint64), np.ones(len(count), np.uint64)
    as_token = [count, one, zero, zero, zero, zero]
    as_context = [zero, zero, count] + [
        m.astype(np.uint64) for m in (count == 1, count == 2, count >= 3)
    ]
    return _sum_by(
        np.concatenate([right, left]), [np.concatenate(x) for x in zip(as_token, as_context)]
    )


def _filesystem(folder: str):
    """File system and path of a folder; a path without scheme is a mounted one."""
    return pyarrow.fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")


def write_array(folder: str, name: str, array: np.ndarray) -> None:
    """Write under a name of its own, then rename: a task that is run again does no harm."""
    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(array.tobytes())
    files.move(draft, f"{path}/{name}")


def map_array(folder: str, name: str, dtype: np.dtype) -> np.ndarray:
    """The array mapped into memory; a missing file is an empty shard."""
    files, path = _filesystem(folder)
    info = files.get_file_info(f"{path}/{name}")
    if info.type == pyarrow.fs.FileType.NotFound or info.size == 0:
        return np.empty(0, dtype)
    if isinstance(files, pyarrow.fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype, "r")
    with tempfile.TemporaryFile() as copy, files.open_input_stream(f"{path}/{name}") as source:
        while part := source.read(1 << 24):
            copy.write(part)
        copy.flush()
        return np.memmap(copy, dtype, "r")


HEADER = 1024


def write_columns(folder: str, name: str, columns: dict[str, np.ndarray]) -> None:
    """Columns of one table in one file, each in the narrowest whole numbers that hold it."""
    parts, places, at = [], [], HEADER
    for field, values in columns.items():
        values = values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)
        pad = -values.nbytes % 8
        parts += [values.tobytes(), bytes(pad)]
        places.append((field, values.dtype.str, at, len(values)))
        at += values.nbytes + pad
    header = json.dumps(places).encode().ljust(HEADER)
    write_array(folder, name, np.frombuffer(header + b"".join(parts), np.uint8))


def map_columns(folder: str, name: str) -> dict[str, np.ndarray]:
    """The columns mapped into memory; none if the shard is empty."""
    whole = map_array(folder, name, np.dtype(np.uint8))
    if not len(whole):
        return {}
    places = json.loads(whole[:HEADER].tobytes())
    return {
        field: np.frombuffer(whole, kind, n, at) for field, kind, at, n in places
    }


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things seen 1, 2, 3 and 4 times.

    Where a number is missing (a corpus too small), half a count and so on are used.
    """
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))


class Model:
    """A fitted model: where its arrays lie, and the few numbers that hold for all of it."""

    def __init__(self, folder: str, shards: int, numbers: dict):
        self.folder, self.shards, self.numbers = folder, shards, numbers

    def describe(self) -> str:
        return json.dumps({"folder": self.folder, "shards": self.shards, "numbers": self.numbers})


class Mapped:
    """The model as a worker sees it."""

    def __init__(self, folder: str, shards: int, numbers: dict):
        self.folder, self.shards, self.n = folder, shards, numbers
        self.tables: dict[tuple[str, int], dict[str, np.ndarray]] = {}

    def _table(self, kind: str, shard: int) -> dict[str, np.ndarray]:
        key = (kind, shard)
        if key not in self.tables:
            self.tables[key] = map_columns(self.folder, f"{kind}-{shard}")
        return self.tables[key]

    def find(self, kind: str, keys: np.ndarray, fields: list[str]) -> np.ndarray:
        """Values of the given fields for sorted keys, 0 where there is none."""
        out = np.zeros((len(fields), len(keys)))
        edges = np.searchsorted(shard_of(keys, self.shards), np.arange(self.shards + 1))
        for s in range(self.shards):
            a, b = edges[s], edges[s + 1]
            if a < b and (table := self._table(kind, s)):
                known = table["key"]
                at = np.minimum(np.searchsorted(known, keys[a:b]), len(known) - 1)
                hit = known[at] == keys[a:b]
                for i, field in enumerate(fields):
                    out[i, a:b] = np.where(hit, table[field][at], 0)
        return out

    def score(self, tokens: list[np.ndarray]) -> pd.DataFrame:
        """Tokens, known tokens and the two log10 probabilities of each text."""
        n = self.n
        left, right = _contexts(tokens)
        words, where = np.unique(np.concatenate([right, left]), return_inverse=True)
        facts = self.find("words", words, WORD_FIELDS)
        count, before = facts[:2][:, where[: len(right)]]
        context, f1, f2, f3 = facts[2:][:, where[len(right):]]
        keys, at = np.unique(pair_hashes(left, right), return_inverse=True)
        pair = self.find("pairs", keys, ["count"])[0][at]
        d, e = n["pair_discounts"], n["word_discounts"]
        unseen = 1 / (n["vocabulary"] + 1)
        if n["pairs"]:
            less = np.choose(np.minimum(before, 3).astype(int), [0.0, *e])
            p = (before - less) / n["pairs"] + n["word_backoff"] * unseen
            less = np.choose(np.minimum(pair, 3).astype(int), [0.0, *d])
            some = np.maximum(context, 1)
            backoff = (d[0] * f1 + d[1] * f2 + d[2] * f3) / some
            p = np.where(context > 0, (pair - less) / some + backoff * p, p)
        else:
            p = np.full(len(right), unseen)
        base = (count + 0.5) / (n["tokens"] + 0.5 * (n["vocabulary"] + 1))
        starts = np.cumsum([0] + [len(t) for t in tokens[:-1]])
        return pd.DataFrame({
            "n_tokens": [len(t) for t in tokens],
            "n_known": np.add.reduceat((count > 0).astype(np.int64), starts),
            "base_score": np.add.reduceat(np.log10(base), starts),
            "score": np.add.reduceat(np.log10(p), starts),
        })


@lru_cache(1)
def mapped(description: str) -> Mapped:
    return Mapped(**json.loads(description))


def _batches(texts: Iterator[str | None]) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for text in texts:
        held.append(token_hashes(text))
        size += len(held[-1])
        if size >= BATCH_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def fit(texts: DataFrame, shards: int | None = None) -> Model:
    """Count the column ``text`` of all rows and write the model to the shared folder."""
    spark = texts.sparkSession
    shards = shards or shuffle_width(spark)
    folder = new_folder(spark, "language-model")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tokens in _batches(t for batch in batches for t in batch["text"]):
            yield pd.DataFrame(_pair_blocks(tokens, shards), columns=["shard", "payload"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        payloads: dict[int, list[bytes]] = {}
        for batch in batches:
            for shard, payload in zip(batch["shard"], batch["payload"]):
                payloads.setdefault(int(shard), []).append(payload)
        for shard, blocks in payloads.items():
            keys, left, right, counts = _merge_pairs(blocks)
            write_columns(folder, f"pairs-{shard}", {"key": keys, "count": counts})
            words, facts = _word_facts(left, right, counts)
            edges = np.searchsorted(shard_of(words, shards), np.arange(shards + 1))
            sizes = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
            rows = []
            for s in range(shards):
                a, b = edges[s], edges[s + 1]
                if a < b:
                    own = [len(keys), *sizes] if not rows else [0] * 5
                    rows.append((s, pack(words[a:b], *(f[a:b] for f in facts)), *own))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATS.split(", ")])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        payloads: dict[int, list[bytes]] = {}
        numbers = np.zeros(5, np.int64)
        for batch in batches:
            numbers += batch[["pairs", "n1", "n2", "n3", "n4"]].sum().to_numpy()
            for shard, payload in zip(batch["shard"], batch["payload"]):
                payloads.setdefault(int(shard), []).append(payload)
        tokens = vocabulary = 0
        sizes = np.zeros(4, np.int64)
        for shard, blocks in payloads.items():
            parts = [unpack(b, *["<u8"] * (1 + len(WORD_FIELDS))) for b in blocks]
            keys, facts = _sum_by(
                np.concatenate([p[0] for p in parts]),
                [np.concatenate([p[i + 1] for p in parts]) for i in range(len(WORD_FIELDS))],
            )
            word = dict(zip(WORD_FIELDS, facts))
            write_columns(folder, f"words-{shard}", {"key": keys, **word})
            tokens += int(word["count"].sum())
            vocabulary += int((word["count"] > 0).sum())
            sizes += [int((word["before"] == k).sum()) for k in (1, 2, 3, 4)]
        yield pd.DataFrame([{
            "tokens": tokens, "vocabulary": vocabulary,
            **{f"n{i + 1}": int(numbers[i + 1]) for i in range(4)}, "pairs": int(numbers[0]),
            **{f"w{i + 1}": int(sizes[i]) for i in range(4)},
        }])

    fields = ["tokens", "vocabulary", "n1", "n2", "n3", "n4", "pairs", "w1", "w2", "w3", "w4"]
    sums = (
        texts.select("text").mapInPandas(count, BLOCK)
        .repartitionById(shards, F.col("shard")).mapInPandas(merge, STATS)
        .repartitionById(shards, F.col("shard"))
        .mapInPandas(finish, ", ".join(f"{f} long" for f in fields))
        .agg(*[F.sum(f).alias(f) for f in fields]).first()
    )
    n = {f: int(sums[f] or 0) for f in fields}
    d = _discounts([n["n1"], n["n2"], n["n3"], n["n4"]])
    e = _discounts([n["w1"], n["w2"], n["w3"], n["w4"]])
    many = n["vocabulary"] - n["w1"] - n["w2"]
    taken = e[0] * n["w1"] + e[1] * n["w2"] + e[2] * many
    return Model(folder, shards, {
        "tokens": n["tokens"], "vocabulary": n["vocabulary"], "pairs": n["pairs"],
        "pair_discounts": d, "word_discounts": e,
        "word_backoff": taken / n["pairs"] if n["pairs"] else 1.0,
    })


SCORES = "n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row."""
    description = model.describe()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = mapped(description)
        for batch in batches:
            parts = [known.score(tokens) for tokens in _batches(iter(batch["text"]))]
            if parts:
                out = pd.concat(parts, ignore_index=True)
                out.insert(0, "doc_id", batch["doc_id"].to_numpy())
                yield out

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(score, f"doc_id {doc_type}, {SCORES}")


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per document: log10 probability under the model, and under single words.

    The model learns from all rows outside the held-out fold. Null and empty texts are one
    end token; repeated rows count as often as they stand; a null doc_id is in fold 0; other
    columns are ignored. Without training rows every token has probability one half of an
    unknown word's share, that is 1; an empty table gives an empty result.
    """
    remainder = fold_remainder("doc_id", HELD_OUT_PARTS)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    model = fit(rows.where(remainder != HELD_OUT))
    return score_texts(rows, model).select(
        "doc_id", (remainder == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.numbers["tokens"]).cast("long").alias("train_tokens"), "base_score", "score",
    )


def perplexity(score: str = "score", tokens: str = "n_tokens"):
    return F.pow(F.lit(10.0), -F.col(score) / F.col(tokens))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir)).withColumn("perplexity", perplexity())
