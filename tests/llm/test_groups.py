"""Near duplicates: lines, n-gram sets, and the components below them."""

import hashlib
import math
import random
import re
from collections import defaultdict
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from fleetveil.llm import line_dedup, ngram_join
from fleetveil.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self, items):
        self.parent = {x: x for x in items}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def plain_groups(texts, words=3, percent=90):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    union, seen = Union(sets), defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for g in sets[i]:
            for j in seen[g]:
                shared[j] += 1
            seen[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                union.join(i, j)
    return {i: (len(s), union.find(i)) for i, s in sets.items()}


def test_op9_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = entry_point.queries()["op9_ngram_jaccard"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got == plain_groups(texts) and len(rows) == len(texts)


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_large_groups_of_near_copies(spark, words, percent):
    """Copies of one text, each changed at random: chains, stars and bare misses."""
    rng = random.Random(words)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    texts = {}
    for i in range(250):
        t = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 9])):
            t[rng.randrange(len(t))] = f"n{rng.randint(0, 60)}"
        texts[i] = " ".join(t[: rng.choice([120, 118, 108])])
    texts |= {300: "a b", 301: "A  b", 302: "a b c", 303: "a", 304: None, 305: " ", 306: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs, words, percent).collect()}
    assert got == plain_groups(texts, words, percent)
    assert got[300] == got[301] and got[304] == (0, 304) and got[305] == (0, 305)


def test_groups_of_odd_rows(odd, empty):
    rows = ngram_join.jaccard_groups(odd).collect()
    assert len(rows) == odd.count()
    same = [r for r in rows if r.n_shingles == 4 and r.component_id == 7]
    assert len(same) == 4 and {r.doc_id for r in same} == {7, 8, None}
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    kept = ngram_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 2 and 8 not in ids and 6 not in ids and {1, 2, 3, 4, 5} <= set(ids)
    assert ngram_join.jaccard_groups(empty).count() == 0
    assert ngram_join.keep_one_of_each(empty).count() == 0


def test_prefix_is_as_long_as_it_must_be():
    for n in range(1, 200):
        least = -(-n * 90 // 100)
        assert ngram_join.prefix_length(n, 90) == n - least + 1


def test_sets_of_few_ngrams_and_of_just_the_least_overlap(spark):
    for n in range(1, 200):
        least = -(-n * 90 // 100)
        assert ngram_join.sent_length(n, 90) == min(n, n - least + ngram_join.MEETINGS)
    texts = ["a b c", "b c d e", "a b c d", "a b c d e", "a b c d e f", "a b c d e g", "f a b c d e f"]
    for n in (21, 31, 40, 59, 60, 61):  # one word replaced in the middle or two: at the limit and beyond
        words = [f"{n}w{i}" for i in range(n)]
        texts += [" ".join(words), " ".join([*words[: n // 2], "x", *words[n // 2 + 1 :]])]
        texts += [" ".join([*words[:-1], "y"]), " ".join(words[: n * 9 // 10]), " ".join(words[1:])]
    texts = dict(enumerate(texts))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs).collect()}
    assert got == plain_groups(texts)


def test_components_of_paths_stars_and_noise(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 400)]
    links += [(rng.randint(500, 700), rng.randint(500, 700)) for _ in range(120)] + [(5, 5), (100, 101)]
    union = Union({x for pair in links for x in pair})
    for a, b in links:
        union.join(a, b)
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in connected_components(frame).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: union.find(x) for x in linked}
    assert connected_components(frame.limit(0)).count() == 0


def occurrences(texts):
    """(doc_id, position, normalised line) in order, and the distinct lines by first occurrence."""
    rows, first = [], {}
    for i in sorted(texts):
        for k, line in enumerate((texts[i] or "").split("\n")):
            n = re.sub("[\x20\x09-\x0d]+", " ", line.lower()).strip(" ")
            if n and len(n.split(" ")) >= 5:
                rows.append((i, k, n))
                first.setdefault(n, len(first))
    return rows, first


def positions_that_go(rows, first, union):
    stays, gone = {}, defaultdict(set)
    for i, k, n in rows:
        if stays.setdefault(union.find(first[n]), (i, k)) != (i, k):
            gone[i].add(k)
    return gone


def plain_simhashes(words):
    x64 = xxhash.xxh64_intdigest
    tags = [x64(t.to_bytes(4, "little"), seed=42) for t in (1, 2)]
    h = [x64(part, seed=tag) for w in words for part, tag in ((w[:3], tags[0]), (w[-3:], tags[1]))]
    g = [x64(x.to_bytes(8, "little"), seed=42) for x in h]
    return tuple(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in f) > len(f)) for f in (h, g))


def plain_lines(texts, agree=2):
    """Positions that go: SimHashes that share blocks, then edit distance, from simple loops."""
    rows, first = occurrences(texts)
    names, union, met = list(first), Union(range(len(first))), defaultdict(list)
    words = [n.split(" ") for n in names]
    edges = [64 * k // (agree + 5) for k in range(agree + 6)]
    hashes = []
    for i, ws in enumerate(words):
        n = len(ws)
        hashes.append(None)
        if n < 9:
            continue
        h, g = hashes[i] = plain_simhashes(ws)
        blocks = [(k, (h & (1 << edges[k + 1]) - 1) >> edges[k]) for k in range(agree + 5)]
        lengths = range(math.floor(math.log(n) / math.log(1.6)), math.floor(math.log(n / 0.9) / math.log(1.6)) + 1)
        near = set()
        for chosen in combinations(blocks, agree):
            for length in lengths:
                near.update(met[chosen, length])
                met[chosen, length].append(i)
        for j in near:
            most = max(n, len(words[j]))
            d = (h ^ hashes[j][0]).bit_count()
            if (
                10 * abs(n - len(words[j])) <= most and d <= 10 and d + (g ^ hashes[j][1]).bit_count() <= 18
                and union.find(i) != union.find(j) and distance(ws, words[j]) * 10 <= most
            ):
                union.join(i, j)
    return positions_that_go(rows, first, union)


def distance(a, b):
    row = list(range(len(b) + 1))
    for x, ca in enumerate(a, 1):
        new = [x]
        for y, cb in enumerate(b, 1):
            new.append(min(row[y] + 1, new[-1] + 1, row[y - 1] + (ca != cb)))
        row = new
    return row[-1]


def pairs_within_the_limit(names):
    """All pairs of lines whose word edit distance is within 10 %, by a filter that loses none.

    An edit changes at most three 3-word n-grams, so near lines of nine words and more share one.
    """
    words, met, out = [n.split(" ") for n in names], defaultdict(list), set()
    for i, ws in enumerate(words):
        near = set()
        for k in range(len(ws) - 2):
            near.update(met[tuple(ws[k : k + 3])])
        for k in range(len(ws) - 2):
            met[tuple(ws[k : k + 3])].append(i)
        for j in near - {i}:
            most = max(len(ws), len(words[j]))
            if 10 * abs(len(ws) - len(words[j])) <= most and distance(ws, words[j]) * 10 <= most:
                out.add((j, i))
    return out


def test_nine_of_ten_near_lines_are_found(spark):
    """Recall of the SimHash blocks against the edit limit alone, over the lines of a table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = line_dedup.line_rows(docs).checkpoint()
    lines = line_dedup.distinct_lines(rows).checkpoint()
    names = {r.line: r.norm for r in rows.join(lines.select("line", "row", "pos"), ["row", "pos"]).collect()}
    near = {
        frozenset(p) for p in pairs_within_the_limit(names.values())
    }
    numbers = list(names)
    group = {r.id: r.component for r in line_dedup.line_groups(lines, rows).collect()}
    together = [
        group.get(numbers[i], -1) == group.get(numbers[j], -2) for i, j in map(tuple, near)
    ]
    assert len(near) > 100 and sum(together) >= 0.9 * len(near)
    # And nothing beyond the limit is linked.
    union = Union(range(len(numbers)))
    for i, j in map(tuple, near):
        union.join(i, j)
    place = {n: k for k, n in enumerate(numbers)}
    assert all(union.find(place[i]) == union.find(place[c]) for i, c in group.items())


def test_lanes_of_every_width_give_one_simhash(spark):
    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randrange(90)}" for _ in range(n)) for n in (9, 31, 62, 63, 64, 65, 200, 9000)]
    lines.append(" ".join(["same"] * 20_000))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    rows = line_dedup.line_rows(docs).checkpoint()
    ids = {r.row: r.doc_id for r in rows.collect()}
    for r in line_dedup.simhashes(rows).collect():
        want = plain_simhashes(lines[ids[r.row]].split(" "))
        assert (r.h & (1 << 64) - 1, r.g & (1 << 64) - 1) == want, ids[r.row]


def test_blocks_grow_with_the_number_of_lines():
    assert line_dedup.agreeing_blocks(0) == line_dedup.agreeing_blocks(2_000_000) == 2
    assert line_dedup.agreeing_blocks(100_000_000) == 3 < line_dedup.agreeing_blocks(10**11)
    for agree in (2, 3):
        assert len(line_dedup.block_sets(agree)) == math.comb(agree + 5, agree)


def test_groups_do_not_depend_on_the_number_of_lines(spark, monkeypatch):
    """The blocks that must agree are the same for a few lines and for very many."""
    asked = []
    keys = line_dedup._keys
    monkeypatch.setattr(line_dedup, "_keys", lambda lines, agree, sets: asked.append(agree) or keys(lines, agree, sets))
    monkeypatch.setattr(line_dedup, "agreeing_blocks", lambda lines: 4)
    docs = spark.createDataFrame([(0, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k x")], "doc_id long, text string")
    line_dedup.dedup_lines(docs).collect()
    assert set(asked) == {2}


def test_parities_lose_no_pair_within_the_edit_limit(spark):
    rng = random.Random(9)
    texts = []
    for n in (10, 19, 40, 130, 400):
        line = [f"w{rng.randrange(3 * n)}" for _ in range(n)]
        for _ in range(20):
            near = list(line)
            for _ in range(n // 10):
                k, kind = rng.randrange(len(near)), rng.randrange(3)
                if kind == 0:
                    near[k] = f"v{rng.randrange(999)}"
                elif kind == 1 and len(near) > 9:
                    del near[k]
                else:
                    near.insert(k, f"v{rng.randrange(999)}")
            texts += [" ".join(near), " ".join(rng.choices(line, k=n))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = line_dedup.line_rows(docs)
    # SimHashes set alike, so that lengths and parities alone decide.
    found = rows.join(line_dedup.simhashes(rows), ["row", "pos"]).select(
        "doc_id", "words", *[F.lit(0).cast("long").alias(c) for c in "hg"], "p", "q"
    ).checkpoint()
    x, y = found.alias("x"), found.alias("y")
    both = x.join(y, F.col("x.doc_id") < F.col("y.doc_id")).where(line_dedup._close("x.", "y."))
    close = {(a, b) for a, b in both.select("x.doc_id", "y.doc_id").collect()}
    words = [t.split(" ") for t in texts]
    near = {
        (i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))
        if i // 40 == j // 40 and distance(words[i], words[j]) * 10 <= max(len(words[i]), len(words[j]))
    }
    assert len(near) > 50 and near <= close and len(close) < 20 * 40 * 5


def test_blocks_of_words_lose_no_pair_and_meet_few_others(spark):
    rng = random.Random(5)
    texts = []
    for n in (10, 19, 25, 60, 110):
        for _ in range(20):
            line = [f"w{rng.randrange(3000)}" for _ in range(n)]
            near = list(line)
            for k in rng.sample(range(n), n // 10):
                near[k] = f"v{rng.randrange(999)}"
            texts += [" ".join(line), " ".join(near)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = line_dedup.line_rows(docs).checkpoint()
    lines = line_dedup.distinct_lines(rows).checkpoint()
    ids = {r.line: r.first.doc_id for r in lines.collect()}
    lots, poor = line_dedup.retrieved(lines, rows)
    found = {frozenset((ids[r.a], ids[r.b])) for lot in lots for r in lot.collect()}
    assert {frozenset((i, i + 1)) for i in range(0, len(texts), 2)} <= found
    assert len(found) < 2 * len(texts) and poor.count() == 0


def test_long_lines_meet_by_blocks_of_words(spark, monkeypatch):
    """No line is left to the keys of whole lines for its length, and few unrelated ones are paired."""
    monkeypatch.setattr(line_dedup, "WORD_KEYS_AT_ONCE", 3000)  # several lots
    rng = random.Random(8)
    texts = []
    for n in (150, 210, 300, 700):
        for _ in range(12):
            line = [f"w{rng.randrange(3000)}" for _ in range(n)]
            near = list(line)
            for k in sorted(rng.sample(range(n), n // 10), reverse=True):
                kind = rng.randrange(3)
                near[k : k + 1] = [[f"v{rng.randrange(999)}"], [], [near[k], f"v{rng.randrange(999)}"]][kind]
            texts += [" ".join(line), " ".join(near)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = line_dedup.distinct_lines(line_dedup.line_rows(docs).checkpoint()).checkpoint()
    ids = {r.line: r.first.doc_id for r in lines.collect()}
    lots, poor = line_dedup.retrieved(lines)
    found = {frozenset((ids[r.a], ids[r.b])) for lot in lots for r in lot.collect()}
    words = [t.split(" ") for t in texts]
    near = {
        frozenset((i, i + 1)) for i in range(0, len(texts), 2)
        if distance(words[i], words[i + 1]) * 10 <= max(len(words[i]), len(words[i + 1]))
    }
    assert len(near) > 20 and near <= found and len(found) < 3 * len(texts)
    assert len(lots) > 1 and poor.count() == 0


def test_words_that_cancel_leave_a_line_to_the_keys_of_whole_lines(spark):
    """Blocks are exclusive ors: a word twice looks like none, so such lines are told as poor."""
    texts = ["same " * 19 + "same", "same " * 20 + "same", "a b c d e f g h i j k l m n o p q r s t"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = line_dedup.distinct_lines(line_dedup.line_rows(docs).checkpoint()).checkpoint()
    ids = {r.line: r.first.doc_id for r in lines.collect()}
    _, poor = line_dedup.retrieved(lines)
    assert {ids[r.line] for r in poor.collect()} >= {0, 1}
    assert [r["__dropped"] for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] == [None, [0], None]


def left_over(text, gone):
    return "\n".join(line for k, line in enumerate((text or "").split("\n")) if k not in gone)


def test_op5_equals_brute_force(spark, small, texts):
    rows = entry_point.queries()["op5_line_dedup"](spark, small).collect()
    gone = plain_lines(texts)
    assert len(rows) == len(texts) and sum(map(len, gone.values())) > 20
    for r in rows:
        t = left_over(texts[r.doc_id], gone[r.doc_id])
        assert (r.n_lines, r.n_dropped) == (len(texts[r.doc_id].split("\n")), len(gone[r.doc_id]))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("hot", [False, True])
def test_a_frequent_line_with_many_variants(spark, monkeypatch, hot):
    if hot:  # keys of two lines and more count as shared by very many
        monkeypatch.setattr(line_dedup, "SAMPLED", 1)
        monkeypatch.setattr(line_dedup, "SAMPLED_HOT", 2)
    rng = random.Random(4)
    base = [f"term{i}" for i in range(40)]
    texts = {}
    for i in range(150):
        line = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            line[rng.randrange(40)] = f"other{rng.randint(0, 30)}"
        own = " ".join(f"own{i}x{j}" for j in range(12))
        texts[i] = f"{own}\n{' '.join(line)}\n\nshort line\n{' '.join(base)}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    gone = plain_lines(texts)
    assert sum(map(len, gone.values())) > 200
    for r in line_dedup.dedup_lines(docs).collect():
        assert set(r["__dropped"] or ()) == gone[r.doc_id]
        assert r.text == left_over(texts[r.doc_id], gone[r.doc_id])


@pytest.mark.parametrize("most", [0, 200_000])
def test_first_round_shuffles_crowded_keys_only(spark, monkeypatch, most):
    """Keys few lines share are left to the second round; with very many crowded ones, lots are small."""
    seen = []
    pivots = line_dedup._pivot_pairs
    monkeypatch.setattr(line_dedup, "_pivot_pairs", lambda rows: seen.append(rows.count()) or pivots(rows))
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", most - 1)
    rng = random.Random(11)
    texts = {i: " ".join(f"w{rng.randrange(5000)}" for _ in range(20)) for i in range(300)}
    texts |= {i: " ".join([*texts[i - 300].split(" ")[:19], f"x{i}"]) for i in range(300, 330)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    gone = plain_lines(texts)
    for r in line_dedup.dedup_lines(docs).collect():
        assert set(r["__dropped"] or ()) == gone[r.doc_id]
    assert sum(map(len, gone.values())) >= 20
    # Each line has a key or two for each set of blocks.
    assert max(seen) <= (0 if most else 2 * line_dedup.PIVOTS_AT_ONCE * len(texts))


@pytest.mark.parametrize("line", ["a\tb c  d e f", " \t a b\x0b\x0cc d e", "a b c d e\r", "a b c d", "", "  ", "ä  ö ü\x0cß é"])
def test_words_of_lines_with_and_without_gaps(spark, line):
    rows = line_dedup.line_rows(spark.createDataFrame([(1, line)], "doc_id long, text string")).collect()
    words = re.findall("[^\x20\x09-\x0d]+", line.lower())
    want = [(len(words), " ".join(words))] if len(words) >= 5 else []
    assert [(r.words, r.norm) for r in rows] == want


def test_lines_of_odd_rows(odd, empty):
    done = line_dedup.dedup_lines(odd)
    rows = done.collect()
    assert len(rows) == odd.count()
    assert next(r for r in rows if r.doc_id == 11).text == "a\nb c d e f g\n\nx"
    assert next(r for r in rows if r.doc_id == 8).text == ""  # its only line is document 7's
    assert [r.text for r in rows if r.doc_id == 7] == ["alpha beta gamma delta epsilon zeta"] * 2
    assert next(r for r in rows if r.doc_id == 1).text is None
    assert [c for c in done.columns if not c.startswith("__")] == odd.columns
    assert line_dedup.dedup_lines(empty).count() == 0


def test_main_path_of_native_operators_has_no_python(spark, small):
    for name in ("op2_license_scan", "op5_line_dedup", "op7_exact_dedup"):
        plan = entry_point.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
