"""Jaccard self-join of documents on word n-grams, by vertical partitioning.

A global order puts rare n-grams first: n-grams fall into a fixed number of buckets, and buckets
are ranked by how many n-grams of the corpus they hold. The order is cut into fragments of
equal mass, so a document's set is a few segments, one in each fragment. Candidates share a few
of the first n-grams of both sets; their overlap is counted in each fragment separately and
summed per pair.

Documents with equal sets are one class from the start. Links inside a large group of near
copies are not enumerated: first every class is compared with one pivot of each n-gram group,
the member with the fewest rarer n-grams, which in a group of copies is the original. The links
found are merged into components, and then only pairs from different components that share one
of their first n-grams are compared. No pair that could join two components is left out, so the
components are exact.

Only classes that stand in a candidate pair send their segments through a shuffle. Tasks learn
which from sorted lists in the shared folder, mapped into memory.

Sets are sets of 64-bit hashes; classes are told apart by a 128-bit hash of the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop_stored, new_folder, shuffle_width, stored, text_or_empty
from .components import connected_components
from .language_model import map_columns, shard_of, write_columns
from .word_hashes import mix, word_hashes

WORDS, PERCENT = 3, 90
#: Buckets of the global order; 5 MB reach each worker, whatever the corpus.
BUCKETS = 1 << 20
SLICE = 1 << 14
FRAGMENTS = 8
#: First n-grams that a pair must share to be compared.
MEETINGS = 3
#: Stands for a null doc_id in the mapped lists.
NO_ID = -(1 << 63)


def ngram_set(words_hashed: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram as a whole."""
    if len(words_hashed) == 0:
        return words_hashed
    width = min(words, len(words_hashed))
    n = len(words_hashed) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix(out + words_hashed[i : i + n])
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def ngram_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The set of each text of an Arrow column."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    for start, end in zip((ends - counts).tolist(), ends.tolist()):
        yield ngram_set(hashes[start:end], words)


def class_key(ngrams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(ngrams.tobytes())


def _buckets(ngrams: np.ndarray) -> np.ndarray:
    return (ngrams & np.uint64(BUCKETS - 1)).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """First n-grams among which two sets share one if their similarity suffices."""
    return n + (-n * percent // 100) + 1


def sent_length(n: int, percent: int) -> int:
    """First n-grams among which two sets share MEETINGS ones if their similarity suffices.

    Similar sets share at least percent of each; behind the last of the first MEETINGS shared
    ones there are that many less MEETINGS, in either set. Fewer are enough for tiny sets.
    """
    return min(n, prefix_length(n, percent) + MEETINGS - 1)


class Order:
    """The global order: rank of each bucket, and the fragment it lies in."""

    def __init__(self, counts: np.ndarray):
        by_count = np.argsort(counts, kind="stable")
        self.rank = np.empty(BUCKETS, np.uint32)
        self.rank[by_count] = np.arange(BUCKETS, dtype=np.uint32)
        mass = np.cumsum(counts[by_count])
        part = mass * FRAGMENTS // (int(mass[-1]) + 1)
        self.fragment = np.empty(BUCKETS, np.uint8)
        self.fragment[by_count] = part

    def first(self, ngrams: np.ndarray, n: int) -> np.ndarray:
        """The first n of the n-grams in the global order."""
        ranks = self.rank[_buckets(ngrams)]
        if n < len(ngrams):  # all that are not behind the n-th rank, ties included
            near = ranks <= np.partition(ranks, n - 1)[n - 1]
            ngrams, ranks = ngrams[near], ranks[near]
        return ngrams[np.lexsort((ngrams, ranks))][:n]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))


def _measured(docs: DataFrame, words: int) -> DataFrame:
    """One row per document (doc_id, n, cls), and each task's bucket counts in slices."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        names = ["doc_id", "n", "cls", "slice", "counts"]
        for batch in batches:
            sets = list(ngram_sets(batch.column("text"), words))
            if sets:
                counts += np.bincount(_buckets(np.concatenate(sets)), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([class_key(s) for s in sets], pa.binary()),
                pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()),
            ], names)
        parts = counts.reshape(-1, SLICE)
        full = [i for i in range(len(parts)) if parts[i].any()]
        yield pa.RecordBatch.from_arrays([
            pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.int64()),
            pa.nulls(len(full), pa.binary()), pa.array(full, pa.int32()),
            pa.array([parts[i].astype(np.uint32).tobytes() for i in full], pa.binary()),
        ], names)

    schema = "doc_id long, n long, cls binary, slice int, counts binary"
    return stored(_rows(docs).mapInArrow(measure, schema), "ngram-sets")


def _order(measured: DataFrame) -> Order:
    """Bucket counts of the whole corpus: BUCKETS / SLICE short arrays reach the driver."""

    def add(key, rows):
        total = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in rows["counts"])
        rows = rows.iloc[:1].copy()
        rows["counts"] = [total.tobytes()]
        return rows

    slices = measured.where("slice IS NOT NULL").select("slice", "counts")
    counts = np.zeros((BUCKETS // SLICE, SLICE), np.int64)
    for row in slices.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():
        counts[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return Order(counts.ravel())


def _meetings(docs: DataFrame, words: int, percent: int, order) -> DataFrame:
    """(token, cls, n, pos): the first n-grams of each class that another class shares."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # copies within a task are one class here already
        for batch in batches:
            keys, sizes, firsts = [], [], []
            for s in ngram_sets(batch.column("text"), words):
                key = class_key(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sizes.append(len(s))
                    firsts.append(order.value.first(s, sent_length(len(s), percent)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), _lists(firsts)],
                ["cls", "n", "tokens"],
            )

    first = _rows(docs).select("text").mapInArrow(emit, "cls binary, n int, tokens array<long>")
    rows = first.select("cls", "n", F.posexplode("tokens").alias("pos", "token"))
    group = Window.partitionBy("token")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag("cls").over(group.orderBy("cls"))
    marked = rows.select(
        "token", "cls", "n", "pos", F.min("cls").over(whole).alias("low"),
        F.max("cls").over(whole).alias("high"), before.alias("before"),
    )
    own = F.col("before").isNull() | (F.col("before") != F.col("cls"))
    return stored(marked.where((F.col("low") != F.col("high")) & own).select("token", "cls", "n", "pos"), "ngram-meetings")


KEY = ["head", "tail"]


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _sharded(keys: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def shard(values):
        heads = _halves([bytes(v) for v in values])[0]
        return values.iloc[:0].astype("int32") if not len(values) else type(values)(
            shard_of(heads, shards).astype(np.int32), index=values.index
        )

    return shard(keys)


def _write_list(rows: DataFrame, folder: str, name: str, shards: int) -> None:
    """(cls, doc_id, other) as sorted columns in the shared folder, by ranges of cls."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple]] = {}
        for batch in batches:
            for s, *row in zip(*[batch.column(c).to_pylist() for c in ("shard", "cls", "doc_id", "other")]):
                found.setdefault(s, []).append(tuple(row))
        for s, rows in found.items():
            head, tail = _halves([r[0] for r in rows])
            other = _halves([r[2] for r in rows])
            order = np.lexsort((tail, head))
            ids = np.array([NO_ID if r[1] is None else r[1] for r in rows], np.int64).view(np.uint64)
            columns = {"head": head, "tail": tail, "doc": ids, "ohead": other[0], "otail": other[1]}
            write_columns(folder, f"{name}-{s}", {k: v[order] for k, v in columns.items()})
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(map(len, found.values()))], pa.int64())})

    sharded = rows.select(_sharded(F.col("cls"), shards).alias("shard"), "cls", "doc_id", "other")
    sharded.repartitionById(shards, F.col("shard")).mapInArrow(write, "n long").agg(F.sum("n")).first()


class Listed:
    """A list made by ``_write_list`` as a worker sees it."""

    def __init__(self, folder: str, name: str, shards: int):
        self.folder, self.name, self.shards = folder, name, shards
        self.tables: dict[int, dict[str, np.ndarray]] = {}

    def find(self, key: bytes, doc_id: int | None) -> list[bytes]:
        """The other side of every row of this class, if this document stands for it."""
        head, tail = np.frombuffer(key, np.uint64)
        s = int(shard_of(np.array([head]), self.shards)[0])
        if s not in self.tables:
            self.tables[s] = map_columns(self.folder, f"{self.name}-{s}")
        table = self.tables[s]
        if not table:
            return []
        doc = np.int64(NO_ID if doc_id is None else doc_id).view(np.uint64)
        at, out = int(np.searchsorted(table["head"], head)), []
        while at < len(table["head"]) and table["head"][at] == head:
            if table["tail"][at] == tail and table["doc"][at] == doc:
                out.append(np.array([table["ohead"][at], table["otail"][at]], np.uint64).tobytes())
            at += 1
        return out


def _segments(docs: DataFrame, words: int, order, folder: str, name: str, shards: int) -> DataFrame:
    """(cls, other, fragment, tokens) for every row of a mapped list."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = Listed(folder, name, shards)
        for batch in batches:
            keys, others, fragments, tokens = [], [], [], []
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), ngram_sets(batch.column("text"), words)):
                key = class_key(s)
                found = listed.find(key, doc_id) if len(s) else []
                if found:
                    parts = order.value.fragment[_buckets(s)]
                    pieces = [(int(f), s[parts == f]) for f in np.unique(parts)]
                    for other in found:
                        for f, piece in pieces:
                            keys.append(key)
                            others.append(other)
                            fragments.append(f)
                            tokens.append(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(others, pa.binary()),
                 pa.array(fragments, pa.int32()), _lists(tokens)],
                ["cls", "other", "fragment", "tokens"],
            )

    return _rows(docs).mapInArrow(emit, "cls binary, other binary, fragment int, tokens array<long>")


def _possible(na: Column, pa: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Length and position bounds of a pair, one of whose first meetings is at these places."""
    most = F.least(na - pa, nb - pb) + (MEETINGS - 1)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (
        most * (100 + percent) >= (na + nb) * percent
    )


def _meeting_often(rows: DataFrame, percent: int) -> DataFrame:
    """(cls, other, both) of the pairs that have enough rows (cls, other, na, nb)."""
    least = F.ceil(F.greatest("na", "nb") * percent / 100)
    counted = rows.groupBy("cls", "other", "na", "nb").agg(F.count(F.lit(1)).alias("meetings"))
    often = counted.where(F.col("meetings") >= F.least(F.lit(MEETINGS), least))
    return often.select("cls", "other", (F.col("na") + F.col("nb")).alias("both"))


def _pivot_pairs(first: DataFrame, percent: int) -> DataFrame:
    """(cls, other, both): each class with the pivot of each of its n-gram groups."""
    pivots = first.groupBy("token").agg(F.min(F.struct("pos", "n", "cls")).alias("p"))
    joined = first.join(pivots, "token").where(
        (F.col("cls") != F.col("p.cls"))
        & _possible(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"), percent)
    )
    rows = joined.select(
        "cls", F.col("p.cls").alias("other"), F.col("n").alias("na"), F.col("p.n").alias("nb")
    )
    return _meeting_often(rows, percent)


def _cross_pairs(first: DataFrame, percent: int) -> DataFrame:
    """All pairs from different components that meet in an n-gram group."""
    mixed = first.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low <> high")
    left = first.join(mixed.select("token"), "token", "left_semi")
    right = left.select("token", F.struct("cls", "n", "pos", "component").alias("p"))
    joined = left.join(right, "token").where(
        (F.col("component") < F.col("p.component"))
        & _possible(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"), percent)
    )
    rows = joined.select(
        "cls", F.col("p.cls").alias("other"), F.col("n").alias("na"), F.col("p.n").alias("nb")
    )
    return _meeting_often(rows, percent)


def _links(docs: DataFrame, words: int, percent: int, order, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that are similar enough, overlaps counted by fragment and summed.

    The first class of a pair sends its segments once for each of its pairs, the other one
    once; both come from the document that stands for the class.
    """
    spark = docs.sparkSession
    folder, shards = new_folder(spark, "ngram-lists"), shuffle_width(spark)
    ids = classes.select("cls", "doc_id")
    members = pairs.join(ids, "cls").select("cls", "doc_id", "other")
    others = pairs.select(F.col("other").alias("cls")).distinct().join(ids, "cls")
    listed = members.union(others.select("cls", "doc_id", F.col("cls").alias("other")))
    _write_list(listed, folder, "pairs", shards)
    sent = stored(_segments(docs, words, order, folder, "pairs", shards), "ngram-segments")
    members = sent.where(F.col("cls") != F.col("other"))
    pivots = sent.where(F.col("cls") == F.col("other")).select(
        "other", "fragment", F.col("tokens").alias("theirs")
    )
    partial = members.join(pivots, ["other", "fragment"]).select(
        "cls", "other", "fragment", F.size(F.array_intersect("tokens", "theirs")).alias("overlap")
    )
    # A row repeated with its doc_id sends its segments twice.
    once = partial.groupBy("cls", "other", "fragment").agg(F.max("overlap").alias("overlap"))
    total = once.groupBy("cls", "other").agg(F.sum("overlap").alias("overlap"))
    enough = F.col("overlap") * (100 + percent) >= F.col("both") * percent
    linked = pairs.join(total, ["cls", "other"]).where(enough)
    links = stored(linked.select(F.col("cls").alias("a"), F.col("other").alias("b")), "ngram-links")
    drop_stored(sent)
    return links


def jaccard_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Two rows link when 100 * |A and B| >= percent * |A or B| for their sets of word n-grams
    (ASCII letters in lower case). Rows with equal non-empty sets always link. Null, empty and
    blank texts have an empty set and stand alone: their component is their own id. component_id
    is the smallest doc_id reachable by links; a null doc_id never is it unless all ids of the
    component are null. Repeated rows give repeated rows; other columns are ignored; an empty
    table gives an empty result.
    """
    measured = _measured(docs, words)
    rows = measured.where("cls IS NOT NULL").select("doc_id", "n", "cls")
    order = docs.sparkSession.sparkContext.broadcast(_order(measured))  # BUCKETS x 5 bytes
    classes = stored(
        rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "ngram-classes"
    )
    first = _meetings(docs, words, percent, order)
    pairs = stored(_pivot_pairs(first, percent), "ngram-pairs")
    links = _links(docs, words, percent, order, pairs, classes)
    drop_stored(pairs)
    groups = stored(connected_components(links), "ngram-components")
    placed = first.join(groups.withColumnRenamed("id", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls")
    )
    pairs = stored(_cross_pairs(placed, percent), "ngram-pairs")
    links = links.union(_links(docs, words, percent, order, pairs, classes))
    drop_stored(pairs)
    drop_stored(first)
    groups = stored(connected_components(links), "ngram-components")
    named = classes.join(groups.withColumnRenamed("id", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls")
    )
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stored(named.join(least, "component").select("cls", "component_id"), "ngram-named")
    linked = rows.where("n > 0").join(named, "cls").select("doc_id", "n", "component_id")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents whose id is their component's smallest, with the columns they came with.

    ``words`` and ``percent`` say when two link, as in ``jaccard_groups``. Rows that share a doc_id are one document: they stay if any of them stands for its group.
    """
    groups = jaccard_groups(docs.select("doc_id", "text"), words, percent)
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = stored(stays.select(F.col("doc_id").alias("__id")).distinct(), "ngram-kept")
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir))
