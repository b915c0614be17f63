"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Labels exist for documents only, so tokens are labelled first: words that occur in far more of
the toxic than of the clean training texts, in a fair share of the toxic ones, are toxic tokens
where they stand in a toxic text. A two-state chain (features: the word, its left and its right
neighbour; transitions) is fitted to windows of labelled tokens by its forward-backward
gradient. Scoring runs forward-backward over all windows of a text; tokens whose marginal
reaches one half are offending, and a logistic curve over the sum of their marginals, fitted to
all labelled training texts, gives the document's score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, drop_stored, fold_remainder, stored, text_or_empty

#: Words in a window; a window is one chain.
WINDOW = 128
#: Windows of toxic and of clean training texts each that the chain is fitted to, at most:
#: those whose hash is smallest. Word counts and the document curve use all training texts.
SAMPLE_WINDOWS = 2_500
#: A toxic word: in this share of the toxic texts, and so many times as frequent there.
LEAST_SHARE, LEAST_RATIO = 0.01, 20.0
LEAST_TEXTS = 3
#: Words with a feature of their own occur so often in the sample.
LEAST_COUNT = 5
#: Labels, of 12 bytes, that are broadcast at most.
BROADCAST_LABELS = 2_000_000
ROUNDS = 70
CUT = 0.7
HELD_OUT_PARTS, HELD_OUT = 3, 1

_EDGES = "[]().,;:!?\"'*#$%&|<>{}"
SPANS = "array<struct<start:int,end:int,probability:double>>"
TAGGED = f"struct<spans:{SPANS},n_words:long>"


def plain(word: str) -> str:
    return word.lower().strip(_EDGES)


def forward_backward(scores: np.ndarray, moves: np.ndarray, begin: np.ndarray, lengths: np.ndarray):
    """Marginals of state 1, pair marginals summed over places, and log partition sums.

    ``scores`` (places, chains) are the log weights of state 1 over state 0, ``moves`` the 2x2
    and ``begin`` the first log weights; places from a chain's length on do not count.
    """
    places, chains = scores.shape
    w, a = np.exp(np.clip(scores, -30, 30)), np.exp(moves)
    live = np.arange(places)[:, None] < lengths
    f0, f1 = np.empty_like(w), np.empty_like(w)
    log_z = np.zeros(chains)
    x0, x1 = np.full(chains, np.exp(begin[0])), np.exp(begin[1]) * w[0]
    for t in range(places):
        if t:
            x0 = f0[t - 1] * a[0, 0] + f1[t - 1] * a[1, 0]
            x1 = (f0[t - 1] * a[0, 1] + f1[t - 1] * a[1, 1]) * w[t]
        z = x0 + x1
        f0[t], f1[t] = x0 / z, x1 / z
        log_z += np.where(live[t], np.log(z), 0.0)
    p = np.empty_like(w)
    pairs = np.zeros((2, 2))
    b0, b1 = np.ones(chains), np.ones(chains)
    for t in range(places - 1, -1, -1):
        s0, s1 = f0[t] * b0, f1[t] * b1
        p[t] = s1 / (s0 + s1)
        if t:
            n0 = a[0, 0] * b0 + a[0, 1] * w[t] * b1
            n1 = a[1, 0] * b0 + a[1, 1] * w[t] * b1
            total = f0[t - 1] * n0 + f1[t - 1] * n1
            on = live[t] / total
            pairs[0, 0] += (on * f0[t - 1] * a[0, 0] * b0).sum()
            pairs[0, 1] += (on * f0[t - 1] * a[0, 1] * w[t] * b1).sum()
            pairs[1, 0] += (on * f1[t - 1] * a[1, 0] * b0).sum()
            pairs[1, 1] += (on * f1[t - 1] * a[1, 1] * w[t] * b1).sum()
            scale = n0 + n1
            b0, b1 = np.where(live[t], n0 / scale, 1.0), np.where(live[t], n1 / scale, 1.0)
    return p * live, pairs, log_z


@dataclass
class Chain:
    """Weights of the fitted chain; word 0 is every word without a feature of its own."""

    words: dict[str, int]
    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    moves: np.ndarray
    begin: np.ndarray

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Log weights of state 1 for each token of one text."""
        out = self.own[ids]
        out[1:] += self.left[ids[:-1]]
        out[:-1] += self.right[ids[1:]]
        return out


def fit_chain(windows: list[tuple[list[str], bool]], toxic_words: set[str]) -> Chain:
    """Maximum likelihood with a small ridge, by full-batch gradient steps (Adam)."""
    texts = [[plain(w) for w in words] for words, _ in windows]
    counts = Counter(w for text in texts for w in text)
    known = sorted(w for w, c in counts.items() if c >= LEAST_COUNT or w in toxic_words)
    words = {w: i + 1 for i, w in enumerate(known)}
    n = len(words) + 1
    lengths = np.array([len(t) for t in texts])
    places = int(lengths.max())
    ids = np.zeros((places, len(texts)), np.int64)
    truth = np.zeros((places, len(texts)))
    for c, (text, (_, toxic)) in enumerate(zip(texts, windows)):
        ids[: len(text), c] = [words.get(w, 0) for w in text]
        if toxic:
            truth[: len(text), c] = [w in toxic_words for w in text]
    live = np.arange(places)[:, None] < lengths
    second = live[1:]
    y = truth[1:] * second, truth[:-1] * second
    seen = np.array([
        [(second * (1 - truth[:-1]) * (1 - truth[1:])).sum(), ((1 - y[1]) * y[0] * second).sum()],
        [(y[1] * (1 - truth[1:]) * second).sum(), (y[0] * y[1]).sum()],
    ])
    first = np.array([(1 - truth[0]).sum(), truth[0].sum()])
    theta = np.zeros(3 * n + 6)
    theta[:n] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        own, left, right = theta[:n], theta[n : 2 * n], theta[2 * n : 3 * n]
        moves, begin = theta[3 * n : 3 * n + 4].reshape(2, 2), theta[3 * n + 4 :]
        scores = own[ids]
        scores[1:] += left[ids[:-1]]
        scores[:-1] += right[ids[1:]] * second
        p, pairs, _ = forward_backward(scores, moves, begin, lengths)
        off = (truth - p) * live
        grad = np.concatenate([
            np.bincount(ids.ravel(), off.ravel(), n),
            np.bincount(ids[:-1].ravel(), (off[1:]).ravel(), n),
            np.bincount(ids[1:].ravel(), (off[:-1] * second).ravel(), n),
            (seen - pairs).ravel(),
            first - np.array([(1 - p[0]).sum(), p[0].sum()]),
        ]) - 0.05 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Chain(
        words, theta[:n].copy(), theta[n : 2 * n].copy(), theta[2 * n : 3 * n].copy(),
        theta[3 * n : 3 * n + 4].reshape(2, 2).copy(), theta[3 * n + 4 :].copy(),
    )


class _Ids(dict):
    def __init__(self, words: dict[str, int]):
        self.words = words

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        i = self.words.get(plain(word), 0)
        if len(word) < 64:
            self[word] = i
        return i


def _offending(chain: Chain, ids: _Ids, texts: list[str]) -> list[tuple[list, int]]:
    """For each text its tokens with a marginal of at least one half (place, next place, p),
    and how many words it has."""
    found: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    sizes = [0] * len(texts)
    owners, firsts, parts = [], [], []
    for d, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").split()
        words = [w.decode("utf-8", "surrogatepass") for w in words]
        sizes[d] = len(words)
        if words:
            scores = chain.scores(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
            for start in range(0, len(words), WINDOW):
                owners.append(d)
                firsts.append(start)
                parts.append(scores[start : start + WINDOW])
    if not parts:
        return list(zip(found, sizes))
    lengths = np.array([len(x) for x in parts])
    grid = np.zeros((WINDOW, len(parts)))
    for c, x in enumerate(parts):
        grid[: len(x), c] = x
    p = forward_backward(grid, chain.moves, chain.begin, lengths)[0]
    places, chains = np.nonzero(p >= 0.5)
    for t, c in sorted(zip(places.tolist(), chains.tolist()), key=lambda x: (x[1], x[0])):
        found[owners[c]].append((firsts[c] + t, firsts[c] + t + 1, float(p[t, c])))
    return list(zip(found, sizes))


def tagged_tokens(text: Column, chain: Chain) -> Column:
    """Of each text the offending tokens (word offsets, marginal probability) and n_words."""
    # Bounded by the sample that the chain was fitted to.
    shared = SparkSession.getActiveSession().sparkContext.broadcast(chain)

    @F.pandas_udf(TAGGED)
    def tag(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        if not hasattr(model, "ids"):
            model.ids = _Ids(model.words)
        out, batch, size = [], [], 0
        for text in texts:
            batch.append(text)
            size += len(text)
            if size > 4_000_000:
                out += _offending(model, model.ids, batch)
                batch, size = [], 0
        out += _offending(model, model.ids, batch)
        return pd.DataFrame({
            "spans": [
                [{"start": a, "end": b, "probability": p} for a, b, p in found] for found, _ in out
            ],
            "n_words": [n for _, n in out],
        })

    return tag(text)


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled rows outside the held-out fold, stored.

    Labels are joined where the documents are read as long as there are few enough of them to
    broadcast; beyond that both sides are shuffled.
    """
    truth = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    ).where(fold_remainder("doc_id", HELD_OUT_PARTS) != HELD_OUT)
    if truth.count() <= BROADCAST_LABELS:
        truth = F.broadcast(truth)
    rows = docs.where(fold_remainder("doc_id", HELD_OUT_PARTS) != HELD_OUT)
    joined = rows.select("doc_id", text_or_empty().alias("text")).join(truth, "doc_id")
    return stored(joined.select("text", (F.col("toxic") == 1).alias("toxic")), "toxicity-training")


def toxic_words(texts: DataFrame) -> set[str]:
    """Words that mark toxic texts, counted over all distinct training texts.

    At most (words of a text) / LEAST_SHARE words can qualify.
    """
    distinct = texts.groupBy("text").agg(F.max("toxic").alias("toxic"))
    sums = distinct.agg(
        F.count_if(F.col("toxic")).alias("t"), F.count_if(~F.col("toxic")).alias("f")
    ).first()
    if not sums.t:
        return set()
    edges = "[" + "".join("\\" + c for c in _EDGES) + "]+"
    other = SPACE.replace("[", "[^").rstrip("+")
    bare = F.regexp_replace(F.lower("text"), f"(?<!{other}){edges}|{edges}(?!{other})", "")
    words = F.explode(F.array_distinct(F.split(bare, SPACE)))
    counts = distinct.select("toxic", words.alias("word")).where("word <> ''").groupBy("word").agg(
        F.count_if(F.col("toxic")).alias("t"), F.count_if(~F.col("toxic")).alias("f")
    )
    least = max(LEAST_TEXTS, LEAST_SHARE * sums.t)
    ratio = (F.col("t") / sums.t) / ((F.col("f") + 0.5) / max(1, sums.f))
    rows = counts.where((F.col("t") >= least) & (ratio >= LEAST_RATIO)).select("word").collect()
    return {r.word for r in rows}


def sample_windows(texts: DataFrame) -> list[tuple[list[str], bool]]:
    """Windows of words with their text's label, a bounded number of each."""
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(WINDOW))
    windows = (
        texts.select(words.alias("words"), "toxic").where(F.size("words") > 0)
        .select("words", "toxic", F.explode(starts).alias("start"))
        .select(F.slice("words", F.col("start") + 1, WINDOW).alias("window"), "toxic")
        .withColumn("h", F.xxhash64("window"))
    )
    out = []
    for toxic in (True, False):
        some = windows.where(F.col("toxic") == toxic)
        rows = some.where(F.col("h") <= _cut(some)).groupBy("h", "window").agg(
            F.count(F.lit(1)).alias("n")
        ).collect()
        chosen: list[list[str]] = []
        for r in sorted(rows, key=lambda r: (r.h, r.window)):
            chosen += [r.window] * min(r.n, SAMPLE_WINDOWS - len(chosen))
        out += [(w, toxic) for w in chosen]
    return out


def _cut(windows: DataFrame) -> int:
    """A hash that the smallest ``SAMPLE_WINDOWS`` windows do not exceed, and few others.

    Windows are counted by the leading bits of their hash, of those on the border by further
    bits, so that the driver sees counts and later about as many windows as it asked for.
    """
    before, inside = 0, F.lit(True)
    for shift in (48, 32, 16, 0):
        bins = windows.where(inside).groupBy(F.shiftright("h", shift).alias("bin")).agg(
            F.countDistinct("h").alias("kinds"), F.count(F.lit(1)).alias("n")
        ).collect()
        here = None
        for r in sorted(bins, key=lambda r: r.bin):
            here = r
            if before + r.n >= SAMPLE_WINDOWS:
                break
            before += r.n
        if here is None:
            return (1 << 63) - 1
        top = ((here.bin + 1) << shift) - 1
        if here.kinds <= 2 * SAMPLE_WINDOWS:
            return top
        inside = F.shiftright("h", shift) == here.bin
    return top


def curve_inputs() -> list[Column]:
    """What the document curve sees: offending weight, and weight in a thousand words."""
    weight, n = F.col("__weight"), F.greatest(F.col("__tagged.n_words"), F.lit(1))
    return [F.log1p(weight), F.log1p(weight * 1000 / n)]


def fit_curve(points: list[tuple[float, float, int, int]]) -> list[float]:
    """Logistic weights (constant, then inputs) for (inputs, toxic, clean) counts; a ridge."""
    x = np.array([(1.0, *p[:2]) for p in points]).reshape(-1, 3)
    t = np.array([p[2] for p in points], float)
    n = t + np.array([p[3] for p in points], float)
    theta, ridge = np.zeros(3), 1e-2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (t - n * p) - ridge * theta
        curvature = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(curvature, gradient)
        theta = theta + step * min(1.0, 3.0 / max(1e-9, float(np.abs(step).max())))
    return [float(v) for v in theta]


@dataclass
class ToxicityModel:
    chain: Chain | None
    curve: list[float]

    def tagged(self, docs: DataFrame) -> DataFrame:
        """``docs`` with __tagged, __weight and __score; all other columns stay."""
        if self.chain is None:
            found = F.struct(F.array().cast(SPANS).alias("spans"), F.lit(0).cast("long").alias("n_words"))
        else:
            found = tagged_tokens(text_or_empty(), self.chain)
        out = docs.withColumn("__tagged", found)
        weight = F.aggregate("__tagged.spans", F.lit(0.0), lambda a, x: a + x["probability"])
        constant, *slopes = self.curve
        z = sum((F.lit(b) * x for b, x in zip(slopes, curve_inputs())), F.lit(constant))
        return out.withColumn("__weight", weight).withColumn("__score", 1 / (1 + F.exp(-z)))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from the labelled rows of ``docs`` outside the held-out fold.

    Without a toxic training text the score is near 0 for all; with no labels at all it is a
    half for all, so nothing is rejected.
    """
    texts = training_texts(docs, labels)
    toxic = toxic_words(texts)
    windows = sample_windows(texts) if toxic else []
    chain = fit_chain(windows, toxic) if windows else None
    tagged = ToxicityModel(chain, [0.0, 0.0, 0.0]).tagged(texts)
    # The inputs have a narrow range, so there are few cells however many texts.
    cells = [F.round(x * 20).alias(f"x{i}") for i, x in enumerate(curve_inputs())]
    points = tagged.groupBy(*cells).agg(
        F.count_if(F.col("toxic")).alias("t"), F.count_if(~F.col("toxic")).alias("f")
    ).orderBy("x0", "x1").collect()
    drop_stored(texts)
    return ToxicityModel(chain, fit_curve([(r.x0 / 20, r.x1 / 20, r.t, r.f) for r in points]))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, toxic_weight, spans) of every row.

    Null texts count as empty; empty texts get the score of a text without offending tokens;
    repeated rows are scored alike; labels without a document and documents without a label
    are fine; other columns are ignored; an empty table gives an empty result.
    """
    tagged = fit(docs, labels).tagged(docs.select("doc_id", "text"))
    return tagged.select(
        "doc_id", (fold_remainder("doc_id", HELD_OUT_PARTS) == HELD_OUT).alias("held_out"),
        F.col("__score").alias("score"), (F.col("__score") >= CUT).cast("int").alias("predicted"),
        F.col("__weight").alias("toxic_weight"), F.col("__tagged.spans").alias("spans"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with the columns they came with."""
    names = docs.columns
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("__doc"), "text")
    tagged = fit(docs, labels).tagged(held)
    return tagged.where(F.col("__score") < CUT).select("__doc.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = toxicity_scores(documents(spark, sf_dir), labels)
    return scores.select("doc_id", "held_out", "score", "predicted", "toxic_weight")
