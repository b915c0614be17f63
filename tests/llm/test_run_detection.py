"""Periodic runs against a search of every period, and the planted query against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np

import __spark_entry__ as entry_point
from fleetveil.llm import run_detection as runs


def plain_runs(words, least=24):
    """(start, length, period): for each period the longest stretches, smallest period first."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, 3 * q) and (s, i + q) not in seen:
                seen.add((s, i + q))
                out.append((s, i + q - s, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 50, 1000]), rng.choice([0, 1, 5, 30, 60, 150, 400])
    words = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        period = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 13, 16, 17, 31, 40]))]
        block = (period * 9)[: int(len(period) * rng.uniform(2, 7))]
        if rng.random() < 0.3:
            block = [*block, rng.randrange(k)] * 4
        at = rng.randint(0, len(words))
        words[at:at] = block
    words = words * rng.choice([1, 1, 1, 2, 3, 4])
    if words and rng.random() < 0.3:
        words[rng.randrange(len(words))] = 999
    return words[:700]


def test_runs_equal_a_search_of_every_period():
    rng, total = random.Random(5), 0
    for least in (24, 24, 6):
        for _ in range(60):
            texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
            flat = np.array([x for t in texts for x in t], np.int64)
            got = runs.text_runs(flat, np.array([len(t) for t in texts]), least)
            for k, words in enumerate(texts):
                found = [tuple(r) for r in got.get(k, np.empty((0, 3))).tolist()]
                assert found == plain_runs(words, least), words
                total += len(found)
    assert total > 1000


def test_fibonacci_words_and_nested_runs():
    a, b = "a", "ab"
    while len(b) < 900:
        a, b = b, b + a
    inner = (["x", "y"] * 20 + ["z"]) * 5
    for words in (list(b), inner, inner + ["q"] + inner, ["w"] * 500, ["w"] * 23, ["w"] * 24):
        ids = np.unique(words, return_inverse=True)[1].astype(np.int64)
        got = runs.text_runs(ids, np.array([len(ids)]))
        assert [tuple(r) for r in got.get(0, np.empty((0, 3))).tolist()] == plain_runs(words)


def test_rules_derive_the_text_they_stand_for():
    rng = random.Random(8)
    words = np.array([rng.randrange(40) for _ in range(300)] * 7, np.int64)
    grammar = runs.Grammar(words, np.array([len(words)]))
    grammar.build(2)
    assert len(grammar.rules) > 100 and len(grammar.borders()) < 60
    for places, border, length in grammar.rules:
        assert len(places) >= 2 and 0 < border < length
        texts = {tuple(words[p : p + length]) for p in places}
        assert len(texts) == 1 and np.all(np.diff(places) >= length)


def plain_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_op13_equals_brute_force(spark, small, texts):
    rows = entry_point.queries()["op13_periodic_runs"](spark, small).collect()
    want = Counter(plain_report(i, t) for i, t in texts.items())
    assert Counter(map(tuple, rows)) == want and sum(r.n_runs for r in rows) > 10


def test_runs_of_odd_rows(spark, odd, empty):
    want = Counter(plain_report(r.doc_id, r.text if len(r.text or "") < 10_000 else "") for r in odd.collect())
    short = odd.where("coalesce(length(text), 0) < 10000").unionByName(
        odd.where("length(text) >= 10000").selectExpr(*[c if c != "text" else "'' AS text" for c in odd.columns])
    )
    assert Counter(map(tuple, runs.run_report(runs.periodic_runs(runs.planted(short))).collect())) == want
    found = {r.doc_id: r for r in runs.periodic_runs(odd).collect()}
    # 30,000 words of 997 different ones in turn, then one more word.
    assert [tuple(x) for x in found[5].runs] == [(0, 30_000, 997)] == [tuple(x) for x in found[6].runs]
    assert len(found[5].collapsed.split()) == 997 and found[6].collapsed == found[5].collapsed + " tail"
    assert found[1].n_words == 0 and found[1].collapsed == "" and found[1].runs == []
    assert runs.periodic_runs(empty).count() == 0 and runs.planted(empty).count() == 0


def test_words_are_split_at_ascii_white_space_alone(spark):
    text = "a b \x1cx y\x0bz\x85 " * 30
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = runs.periodic_runs(docs).first()
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert row.n_words == len(words) and [tuple(r) for r in row.runs] == plain_runs(words)
