"""The language model against the textbook formulas in plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import __spark_entry__ as entry_point
from fleetveil.llm import language_model as lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [("end",)]


class Plain:
    def __init__(self, train):
        self.single, self.pairs = Counter(), Counter()
        for t in train:
            self.single.update(t)
            self.pairs.update(zip([("begin",), *t[:-1]], t))
        self.n, self.v = sum(self.single.values()), len(self.single)
        self.before, self.context, self.follow = Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
        for (left, right), c in self.pairs.items():
            self.before[right] += 1
            self.context[left] += c
            self.follow[left][min(c, 3) - 1] += 1
        self.d = lm._discounts([sum(c == k for c in self.pairs.values()) for k in (1, 2, 3, 4)])
        self.e = lm._discounts([sum(c == k for c in self.before.values()) for k in (1, 2, 3, 4)])
        taken = sum(self.e[min(c, 3) - 1] for c in self.before.values())
        self.rest = taken / len(self.pairs) if self.pairs else 1.0

    def word(self, w):
        unseen = 1 / (self.v + 1)
        if not self.pairs:
            return unseen
        c = self.before[w]
        return (c - (self.e[min(c, 3) - 1] if c else 0)) / len(self.pairs) + self.rest * unseen

    def pair(self, left, w):
        total = self.context[left]
        if not total:
            return self.word(w)
        c = self.pairs[left, w]
        backoff = sum(d * n for d, n in zip(self.d, self.follow[left])) / total
        return (c - (self.d[min(c, 3) - 1] if c else 0)) / total + backoff * self.word(w)

    def scores(self, t):
        base = sum(math.log10((self.single[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in t)
        return base, sum(math.log10(self.pair(a, b)) for a, b in zip([("begin",), *t[:-1]], t))


def agrees(rows, texts):
    plain = Plain([tokens(t) for i, t in texts if zlib.crc32(str(i if i is not None else "").encode()) % 5 != 1])
    want = Counter()
    for i, t in texts:
        base, score = plain.scores(tokens(t))
        known = sum(plain.single[w] > 0 for w in tokens(t))
        want[i, len(tokens(t)), known, plain.n, f"{base:.6f}", f"{score:.6f}"] += 1
    got = Counter(
        (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6f}", f"{r.score:.6f}")
        for r in rows
    )
    assert got == want
    return plain


def test_op10_equals_the_formulas(spark, small, texts):
    rows = entry_point.queries()["op10_lm_scores"](spark, small).collect()
    plain = agrees(rows, list(texts.items()))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    # Probabilities of all words and the unknown one add up to 1.
    for left in [("begin",), "the", "nowhere-seen"]:
        total = sum(plain.pair(left, w) for w in plain.single) + plain.pair(left, "nowhere-seen")
        assert abs(total - 1) < 1e-9


def test_model_beats_single_words_on_held_out_text(spark):
    rows = entry_point.queries()["op10_lm_scores"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_small_batches_give_the_same_scores(docs, texts, monkeypatch):
    monkeypatch.setattr(lm, "BATCH_TOKENS", 500)
    agrees(lm.lm_scores(docs.repartition(3)).collect(), list(texts.items()))


def test_odd_rows(spark, odd, empty):
    agrees(lm.lm_scores(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert lm.lm_scores(empty).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    rows = lm.lm_scores(only_held).collect()
    assert rows and all(r.train_tokens == 0 and r.score == 0 and r.n_known == 0 for r in rows)


def test_arrays_survive_a_second_write(tmp_path):
    folder = f"file://{tmp_path}/arrays"
    for values in ([3, 1 << 40], [5, 7]):
        lm.write_columns(folder, "t-0", {"key": np.array(values, np.uint64), "count": np.array([1, 2])})
    table = lm.map_columns(folder, "t-0")
    assert table["key"].tolist() == [5, 7] and table["count"].dtype == np.uint8
    assert lm.map_columns(folder, "t-1") == {}
    assert [p.name for p in (tmp_path / "arrays").iterdir()] == ["t-0"]
