"""Periodic runs of words, found on a grammar of each text.

A run is a maximal stretch of words that repeats with some smallest period at least three times.
Re-Pair turns the word ids of a text into rules X -> Y Z that occur at least twice, and a start
rule of what is left. Every run crosses the border of the lowest rule that holds it, so the runs
that cross each rule's border are computed once, in one of its expansions, and those that cross a
border of the start rule in the text itself; a rule's runs are then translated to all places where
it is derived. A run that a rule's expansion cuts off is found whole further up, so the intervals
of one period that overlap by a period are merged into maximal ones.

Rules are made in rounds over a batch of texts: in each, every pair that is more frequent than
the pairs that overlap it is replaced. A pair met once can never become frequent, so later rounds
look only at what still repeats.

Runs that cross a border are found by their period's size: a run of period q agrees with itself q
words further on for at least 2q words, and for two thirds of the least length. So with w the
largest of 8, 16, 32 ... up to q (8, a third of the least length, at least) the w words before or
behind the border lie in it and occur again q words away. Groups of equal words of these lengths
are named by sorting, and only what repeats goes on to the next length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, bound, documents, text_or_empty
from .word_hashes import mix

MIN_LENGTH, MIN_PERIODS = 24, 3
#: Bytes of text whose grammars are made together.
BATCH_BYTES = 3 << 20

Run = tuple[int, int, int]  # start, end, period


class Grammar:
    """Re-Pair of the texts laid end to end; places are word numbers in that row."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        n = len(ids)
        self.n = n
        self.ends = np.cumsum(sizes)
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        # One more place, n, stands for the ends of texts.
        self.symbol = np.append(ids, -1).astype(np.int64)
        self.length = np.append(np.ones(n, np.int64), 0)
        self.next = np.append(np.arange(1, n + 1), n)
        self.prev = np.append(np.arange(-1, n - 1), n)
        filled = sizes > 0
        self.next[self.ends[filled] - 1] = n
        self.prev[(self.ends - sizes)[filled]] = n
        self.alive = np.ones(n + 1, bool)
        self.symbols = int(ids.max()) + 1 if n else 0
        #: (places, border, length) of each rule long enough to hold a run.
        self.rules: list[tuple[np.ndarray, int, int]] = []

    def build(self, least: int) -> None:
        at = np.flatnonzero(self.next[: self.n] != self.n)
        while len(at):
            at = self._round(at, least)

    def _round(self, at: np.ndarray, least: int) -> np.ndarray:
        """Replace the pairs that begin at some of the places; the places of the next round."""
        follow = self.next[at]
        key = self.symbol[at] * self.symbols + self.symbol[follow]
        order = np.argsort(key, kind="stable")
        at, follow, key = at[order], follow[order], key[order]
        text = self.text[at]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        group = np.cumsum(new) - 1
        # Of overlapping places of one pair, as in a a a, every second counts.
        chained = np.zeros(len(at), bool)
        chained[1:] = ~new[1:] & (follow[:-1] == at[1:])
        index = np.arange(len(at))
        apart = (index - np.maximum.accumulate(np.where(chained, 0, index))) % 2 == 0
        count = np.bincount(group, weights=apart).astype(np.int64)
        often = count >= 2
        if not often.any():
            return at[:0]
        # More frequent pairs go first, among equals the one with the smaller key.
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count), 0, -1)
        keep = often[group]
        at, follow, group, apart = at[keep], follow[keep], group[keep], apart[keep]
        score = np.zeros(self.n + 1, np.int64)
        score[at[apart]] = rank[group[apart]]
        own = score[at]
        chosen = apart & (own > score[follow]) & (own > score[self.prev[at]])
        chosen &= (np.bincount(group[chosen], minlength=len(count)) >= 2)[group]
        made, right, of = at[chosen], follow[chosen], group[chosen]
        _, firsts, rule = np.unique(of, return_index=True, return_inverse=True)
        border = self.length[made]
        self.symbol[made] = self.symbols + rule
        self.symbols += len(firsts)
        self.length[made] += self.length[right]
        after = self.next[right]
        self.next[made] = after
        self.prev[after] = made
        self.prev[self.n] = self.n
        self.alive[right] = False
        lasts = np.append(firsts[1:], len(made))
        for k in np.flatnonzero(self.length[made[firsts]] >= least):
            places = made[firsts[k] : lasts[k]]
            self.rules.append((places, int(border[firsts[k]]), int(self.length[places[0]])))
        rest = np.unique(np.concatenate([at, made, self.prev[made]]))
        rest = rest[rest < self.n]
        return rest[self.alive[rest] & (self.next[rest] != self.n)]

    def borders(self) -> np.ndarray:
        """Places in front of which the start rules of the texts have a border."""
        inner = self.alive[: self.n] & (self.prev[: self.n] != self.n)
        return np.flatnonzero(inner)


def _same(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the places whose key another place has too: (group, place), ordered."""
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(new) - 1
    repeated = np.bincount(group, minlength=1)[group] > 1
    return group[repeated], places[repeated]


class Repeats:
    """Places whose next 8, 16, 32 ... words (if 8 are the first) occur again in their text."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, width: int):
        self.ids, self.ends = ids, np.repeat(np.cumsum(sizes), sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        n = len(ids) - width + 1
        self.width = width
        if n <= 0:
            self.group, self.places = np.empty(0, np.int64), np.empty(0, np.int64)
            return
        mixed = mix(ids.astype(np.uint64) + np.uint64(1))
        factor, hashes = np.uint64(0x9E3779B97F4A7C15), np.zeros(n, np.uint64)
        for k in range(width):
            hashes = hashes * factor + mixed[k : k + n]
        hashes += mix(text[:n].astype(np.uint64) + np.uint64(77))
        places = np.flatnonzero(np.arange(n) + width <= self.ends[:n])
        self.group, self.places = _same(hashes[places], places)

    def longer(self) -> None:
        """From groups of some length to those of twice the length."""
        name = np.full(len(self.ids) + 1, -1, np.int64)
        name[self.places] = self.group
        places = np.sort(self.places)
        behind = np.minimum(places + self.width, len(self.ids))
        inside = (name[behind] >= 0) & (places + 2 * self.width <= self.ends[places])
        places, behind = places[inside], behind[inside]
        keys = name[places] * (int(self.group.max(initial=0)) + 1) + name[behind]
        self.group, self.places = _same(keys, places)
        self.width *= 2

    def near(self, places: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(which, other): for each of the places, those of its group at such distances."""
        span = len(self.ids) + 2 * most + 2
        coded = self.group * span + self.places + most
        name = np.full(len(self.ids) + 1, -1, np.int64)
        name[self.places] = self.group
        valid = (places >= 0) & (places < len(self.ids))
        own = np.where(valid, name[np.where(valid, places, len(self.ids))], -1)
        which = np.flatnonzero(own >= 0)
        base = own[which] * span + places[which] + most
        lows = np.searchsorted(coded, base - most)
        counts = np.searchsorted(coded, base + most, "right") - lows
        rows = np.repeat(which, counts)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lows, counts)
        other = self.places[at]
        far = np.abs(other - places[rows])
        keep = (far >= least) & (far <= most)
        return rows[keep], other[keep]


def _agree(ids: np.ndarray, i: int, j: int, end: int) -> int:
    """How many words from i on equal those from j on, i < j, up to ``end``."""
    done, step = 0, 32
    while True:
        n = min(step, end - j - done)
        if n <= 0:
            return done
        differ = ids[i + done : i + done + n] != ids[j + done : j + done + n]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, step = done + n, step * 4


def _agree_back(ids: np.ndarray, i: int, j: int, begin: int) -> int:
    """How many words before i equal those before j, i < j, down to ``begin``."""
    done, step = 0, 32
    while True:
        n = min(step, i - begin - done)
        if n <= 0:
            return done
        differ = (ids[i - done - n : i - done] != ids[j - done - n : j - done])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, step = done + n, step * 4


def crossing_runs(
    ids: np.ndarray, sizes: np.ndarray, borders: np.ndarray, lows: np.ndarray, highs: np.ndarray,
    shared: np.ndarray, least: int = MIN_LENGTH,
) -> dict[int, list[Run]]:
    """The runs across each border within the words from its low to its high place.

    Borders with the same number in ``shared`` lie in the same window and share what they find;
    the result is by that number.
    """
    found: dict[int, list[Run]] = {}
    group = max(1, least // MIN_PERIODS)
    repeats = Repeats(ids, sizes, group)
    widest = int((highs - lows).max(initial=0)) // MIN_PERIODS
    while len(repeats.places):
        width = repeats.width
        if width > max(widest, group):
            break
        shortest = width if width > group else 1
        for places in (borders, borders - width):
            which, other = repeats.near(places, shortest, 2 * width - 1)
            own, low, high = places[which], lows[which], highs[which]
            period = np.abs(other - own)
            inside = (
                (np.minimum(own, other) >= low) & (np.maximum(own, other) + width <= high)
                & (period * MIN_PERIODS <= high - low)
            )
            which, own, other, period = which[inside], own[inside], other[inside], period[inside]
            order = np.lexsort((period, which))
            which, first, period = which[order], np.minimum(own, other)[order], period[order]
            starts = np.flatnonzero(np.diff(which, prepend=-1))
            for at, end in zip(starts, np.append(starts[1:], len(which))):
                k = int(which[at])
                runs = found.setdefault(int(shared[k]), [])
                _check(ids, first[at:end], period[at:end], int(lows[k]), int(highs[k]), width, least, runs)
        repeats.longer()
    return {k: runs for k, runs in found.items() if runs}


def _check(
    ids: np.ndarray, first: np.ndarray, period: np.ndarray, low: int, high: int, width: int,
    least: int, runs: list[Run],
) -> None:
    """Add to ``runs`` those that some places and their periods, ascending, belong to."""
    if len(first) > 16:  # within a run of a short period nearly all belong to it
        for run in runs:
            first, period = _unknown(first, period, width, run)
    while len(first):
        i, q = int(first[0]), int(period[0])
        first, period = first[1:], period[1:]
        if any(i >= s and i + q + width <= e and not q % p for s, e, p in runs):
            continue
        s = i - _agree_back(ids, i, i + q, low)
        e = i + q + _agree(ids, i, i + q, high)
        if e - s >= max(least, MIN_PERIODS * q):
            runs.append((s, e, q))
            first, period = _unknown(first, period, width, runs[-1])


def _unknown(first: np.ndarray, period: np.ndarray, width: int, run: Run) -> tuple:
    s, e, q = run
    other = (first < s) | (first + period + width > e) | (period % q != 0)
    return first[other], period[other]


def merged(runs: np.ndarray) -> np.ndarray:
    """Maximal intervals of rows (start, end, period): parts of one run overlap by a period."""
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    out: list[list[int]] = []
    for s, e, q in runs.tolist():
        if out and out[-1][2] == q and s + q <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, q])
    return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64)


def text_runs(ids: np.ndarray, sizes: np.ndarray, least: int = MIN_LENGTH) -> dict[int, np.ndarray]:
    """Runs of each text that has any, rows (start, length, period) by start, then period."""
    grammar = Grammar(ids, sizes)
    grammar.build(least)
    tops, rules = grammar.borders(), grammar.rules
    ends = grammar.ends
    text = grammar.text[tops] if grammar.n else tops
    firsts = np.array([r[0][0] for r in rules], np.int64)
    borders = np.concatenate([tops, firsts + np.array([r[1] for r in rules], np.int64)])
    lows = np.concatenate([(ends - sizes)[text], firsts])
    highs = np.concatenate([ends[text], firsts + np.array([r[2] for r in rules], np.int64)])
    shared = np.concatenate([text, len(sizes) + np.arange(len(rules))])
    by_text: dict[int, list[np.ndarray]] = {}
    for k, runs in crossing_runs(ids, sizes, borders, lows, highs, shared, least).items():
        found = np.array(runs, np.int64)
        if k < len(sizes):
            by_text.setdefault(k, []).append(found)
            continue
        places = rules[k - len(sizes)][0]
        moves = places - places[0]
        all_of = (found[:, None, :] + moves[None, :, None] * np.array([1, 1, 0])).reshape(-1, 3)
        owner = int(grammar.text[places[0]])  # rules belong to one text each
        by_text.setdefault(owner, []).append(all_of)
    out = {}
    for k, parts in sorted(by_text.items()):
        whole = merged(np.unique(np.concatenate(parts), axis=0))
        start = int(ends[k] - sizes[k])
        out[k] = np.stack([whole[:, 0] - start, whole[:, 1] - whole[:, 0], whole[:, 2]], axis=1)
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by blanks without those that some run holds behind its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)])


def _batch(texts: list[bytes | None], least: int) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    words = [(t or b"").split() for t in texts]  # bytes are split at ASCII white space alone
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for ws in words for w in ws]
    ids = pd.factorize(flat)[0].astype(np.int64)
    runs = text_runs(ids, sizes, least)
    none = np.empty((0, 3), np.int64)
    left = [collapsed(w, runs[k]) if k in runs else b" ".join(w) for k, w in enumerate(words)]
    return sizes.tolist(), [runs.get(k, none) for k in range(len(words))], left


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row, whole texts.

    ``runs`` are (start, length, period) in words, ordered by start and period; a run has at
    least ``least`` words and three periods. ``collapsed`` is the text with one blank between
    words and without what a run repeats. A null or empty text has no words and no runs. Repeated
    rows give repeated rows, other columns are ignored, an empty table gives an empty result.
    Rows are not shuffled; a very long text is the work of one task, in memory in proportion to
    its words.
    """

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            size = np.array(pc.fill_null(pc.binary_length(texts), 0), np.int64)
            part = np.cumsum(size) // BATCH_BYTES
            for at, end in _ranges(part):
                counts, runs, left = _batch(texts.slice(at, end - at).to_pylist(), least)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
                flat = np.concatenate(runs)
                structs = pa.StructArray.from_arrays(
                    [pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, end - at), pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs),
                        pa.array(left, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        detect,
        f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, "
        "collapsed string",
    )


def _ranges(part: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-2))
    return zip(edges[:-1].tolist(), edges[1:].tolist())


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by its id's checksum ends periodically.

    With h the checksum, g = h div 10 and n words, words from a = g mod n on repeat those from
    a with period 1 + (n - a) div (3 + g mod 8). A null id leaves the text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.when(n > 0, g % n).otherwise(0)
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        # The words before a, then the period as often as needed, cut to the length.
        places = F.transform(
            F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))),
            lambda i: F.when(i < a, i).otherwise(a + (i - a) % p),
        )
        return F.array_join(F.transform(places, lambda i: F.get(words, i.cast("int"))), " ")

    words = F.filter(F.split(text_or_empty(), SPACE), lambda w: w != "")
    text = F.when(h % 10 == 0, bound(words, repeat)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def run_report(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the most repetitive one, and digests of the results."""
    order = (
        "array_sort(runs, (x, y) -> CASE "
        "WHEN x.length * y.period <> y.length * x.period "
        "THEN IF(x.length * y.period > y.length * x.period, -1, 1) "
        "WHEN x.start <> y.start THEN IF(x.start < y.start, -1, 1) "
        "ELSE CAST(SIGN(x.period - y.period) AS INT) END)"
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("best")
    return found.withColumn("best", F.get(F.expr(order), 0)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(periodic_runs(planted(documents(spark, sf_dir))))
