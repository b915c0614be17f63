"""Quality rules, toxicity, license scan and exact deduplication."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_point
from compare import compare, duck
from fleetveil.llm import exact_dedup, license_scan, quality_rules, toxicity
from fleetveil.llm.license_templates import TEMPLATES
from fleetveil.llm.text_stats import text_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= set(range(i, i + 8))
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, dups, len(covered)


def test_statistics_by_definition(texts):
    odd = [None, "", " \n", "a", "a b " * 50, "x y z\nx y z\n\n \nx y z", "é\x1cß \x85 ü" * 9, "# $ <|>"]
    for text in [*texts.values(), *odd]:
        assert text_stats(text) == plain_stats(text)


def test_op3_base_and_verdicts(spark, small, texts):
    rows = entry_point.queries()["op3_quality_rules"](spark, small).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    for r in rows:
        want = plain_stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def mcd(x, floors):
    """The estimate by definition, on one group in memory."""
    n, p = x.shape
    grid = np.array(floors) / 16
    bins = np.floor(x / grid + 0.5)
    mid = np.sort(bins, axis=0)[int(np.ceil(n * 0.5)) - 1]
    mad = np.sort(np.abs(bins - mid), axis=0)[int(np.ceil(n * 0.5)) - 1]
    m, inv = mid * grid, np.diag(1 / np.maximum(1.4826 * mad * grid, floors) ** 2)
    share = quality_rules.KEPT_SHARE
    factor = share / quality_rules.chi2_cdf(quality_rules.chi2_quantile(share, p), p + 2)
    for step in range(quality_rules.STEPS + 1):
        d2 = np.maximum(((x - m) @ inv * (x - m)).sum(1), 0)
        if step < quality_rules.STEPS:
            b = np.floor(np.log1p(d2) * 200)
            near, f = b <= np.sort(b)[int(np.ceil(n * share)) - 1], factor
        else:
            near, f = d2 <= quality_rules.chi2_quantile(0.975, p), 1.0
        m, s = x[near].mean(0), np.cov(x[near].T, bias=True) * f
        inv = np.linalg.inv(s + np.diag(np.maximum(0, np.array(floors) ** 2 - np.diag(s))))
    return np.maximum(((x - m) @ inv * (x - m)).sum(1), 0)


def test_distances_equal_an_estimate_in_memory(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("source IN ('src0', 'src1', 'src2')")
    rows = [r for r in quality_rules.quality_verdicts(docs.withColumn("lang", quality_rules.F.lit("en"))).collect() if not r.base_failed]
    if len(rows) < quality_rules.MIN_GROUP:
        pytest.skip("too few rows for an estimate")
    source = dict(docs.select("doc_id", "source").collect())
    n = Counter(source[r.doc_id] for r in rows)
    assert max(n.values()) < quality_rules.MIN_GROUP  # so the language's estimate is used
    w = np.array([r.n_words for r in rows], float)
    x = np.stack([
        np.log(w), np.log((np.array([r.word_chars for r in rows]) + 60) / (w + 10)),
        np.sqrt([r.n_symbols / r.word_chars for r in rows]),
        np.sqrt([r.n_dup_lines / r.n_words for r in rows]),
        np.sqrt([r.n_repeat_words / r.n_words for r in rows]),
    ], axis=1)
    want = mcd(x, [f for _, _, f in quality_rules.VECTOR])
    assert np.allclose([r.distance2 for r in rows], want, rtol=1e-6, atol=1e-9)


def test_junk_goes_and_clean_text_stays(spark):
    folder = "/root/testdata/sf0.01"
    rows = entry_point.queries()["op3_quality_rules"](spark, folder).collect()
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    judged = [r for r in rows if r.doc_id in quality and not r.base_failed]
    good = [r.kept for r in judged if quality[r.doc_id] == 1]
    junk = [r.kept for r in judged if quality[r.doc_id] == 0]
    assert all(good) and sum(junk) <= 0.2 * len(junk)


def test_chi_square():
    assert abs(quality_rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(quality_rules.chi2_cdf(2.0, 2) - (1 - np.exp(-1))) < 1e-12


def test_quality_of_odd_rows(odd, empty):
    rows = quality_rules.quality_verdicts(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3, 4, 10))
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert quality_rules.quality_verdicts(empty).count() == 0
    assert quality_rules.keep_good(empty).count() == 0


def brute_marginals(scores, moves, begin):
    """All labellings of a short chain."""
    n = len(scores)
    total, ones, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for k in range(1 << n):
        y = [k >> t & 1 for t in range(n)]
        s = begin[y[0]] + sum(scores[t] * y[t] for t in range(n))
        s = np.exp(s + sum(moves[a, b] for a, b in zip(y, y[1:])))
        total += s
        ones += s * np.array(y)
        for a, b in zip(y, y[1:]):
            pairs[a, b] += s
    return ones / total, pairs / total, np.log(total)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(5)
    lengths = np.array([1, 2, 5, 8])
    scores, moves, begin = rng.normal(size=(8, 4)), rng.normal(size=(2, 2)), rng.normal(size=2)
    p, pairs, log_z = toxicity.forward_backward(scores, moves, begin, lengths)
    want = [brute_marginals(scores[:n, c], moves, begin) for c, n in enumerate(lengths)]
    for c, (ones, _, z) in enumerate(want):
        assert np.allclose(p[: lengths[c], c], ones) and not p[lengths[c]:, c].any()
        assert np.isclose(log_z[c], z)
    assert np.allclose(pairs, sum(w[1] for w in want))


def test_op8_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = entry_point.queries()["op8_toxicity"](spark, folder).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    hits, claims = sum(p and t for p, t in held), sum(p for p, _ in held)
    assert hits >= 0.9 * sum(t for _, t in held) and hits >= 0.97 * claims


def test_toxicity_of_odd_rows_and_labels(spark, odd, empty):
    labels = spark.createDataFrame(
        [(1, 0, 0), (4, 1, 1), (4, 1, 0), (None, 1, 1), (77, 0, 1), (7, 0, None)],
        "doc_id long, quality int, toxic int",
    )
    rows = toxicity.toxicity_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    assert all(r.score == 0.5 for r in toxicity.toxicity_scores(odd, none).collect())
    assert toxicity.drop_toxic(odd, none).columns == odd.columns
    assert toxicity.drop_toxic(odd, none).count() == odd.count()
    assert toxicity.toxicity_scores(empty, labels).count() == 0


@pytest.mark.parametrize("most", [1, 7, 60, 10_000])
def test_sampled_windows_are_those_with_the_smallest_hashes(spark, monkeypatch, most):
    monkeypatch.setattr(toxicity, "SAMPLE_WINDOWS", most)
    texts = [(" ".join(f"w{i % 40}x{k}" for k in range(300)), i % 3 == 0) for i in range(90)] + [("same text", True)] * 20
    frame = spark.createDataFrame(texts, "text string, toxic boolean").repartition(4)
    got = toxicity.sample_windows(frame)
    windows = [
        (t.split(" ")[k : k + toxicity.WINDOW], toxic) for t, toxic in texts
        for k in range(0, len(t.split(" ")), toxicity.WINDOW)
    ]
    hashed = spark.createDataFrame(windows, "w array<string>, toxic boolean").selectExpr("xxhash64(w) AS h", "w", "toxic").collect()
    for toxic in (True, False):
        want = [r.w for r in sorted((r for r in hashed if r.toxic == toxic), key=lambda r: (r.h, r.w))][:most]
        assert [w for w, t in got if t == toxic] == want
    assert toxicity.sample_windows(frame.limit(0)) == []


def test_spans_name_the_offending_words(spark):
    filler = "calm words of a quiet day go on and on and say nothing much at all".split()
    rows = []
    for i in range(120):
        words = filler[i % 7 :] + filler
        if i % 3 == 0:
            words = words[:5] + ["Grumpf!"] + words[5:9] + ["snarl,"] + words[9:]
        rows.append((i, f"{i} " + " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scores = toxicity.toxicity_scores(docs.drop("toxic"), docs.select("doc_id", "toxic")).collect()
    for r in scores:
        toxic = r.doc_id % 3 == 0
        assert (r.score >= 0.7) == toxic
        assert [(s.start, s.end) for s in r.spans] == ([(6, 7), (11, 12)] if toxic else [])


EDGES = "[]().,;:!?\"'*#$%&|<>{}"


def plain_words(text):
    return [x for x in (v.strip(EDGES) for v in re.split("[\x20\x09-\x0d]+", text.lower())) if x]


def plain_shingles(words, width):
    """All runs of ``width`` words; fewer words are one run."""
    return [" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, min(len(words), 1)))]


def plain_matches(texts, templates):
    """Best containment over all windows, by shingles as wide as the template, five words at most."""
    out = {}
    known = []
    for name, _, t in templates:
        width = min(5, len(plain_words(t)))
        known.append((name, width, set(plain_shingles(plain_words(t), width))))
    for i, text in texts.items():
        words = plain_words(text)
        by_width = {k: plain_shingles(words, k) for k in {w for _, w, _ in known}}
        for name, width, ts in known:
            s = by_width[width]
            if not ts & set(s):
                continue
            c = 1 << (len(ts) - 1).bit_length()
            steps = range(0, len(s), max(1, c // 2))
            best = max((len(ts & set(s[k : k + max(1, 3 * c // 2)])) / len(ts) for k in steps), default=0)
            if best >= 0.8:
                out[i, name] = round(best, 9)
    return out


def test_op2_equals_containment_in_all_windows(spark):
    folder = "/root/testdata/sf0.01"
    rows = entry_point.queries()["op2_license_scan"](spark, folder).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())
    got = {(r.doc_id, r.template): round(r.containment, 9) for r in rows}
    assert got == plain_matches(texts, TEMPLATES) and len(got) == len(rows) > 20


def test_edited_notices_are_found(spark):
    texts = {}
    for k, (_, _, t) in enumerate(TEMPLATES):
        words = t.split()
        if len(words) > 30:
            words[len(words) // 3] = "edited"
        texts[k] = " ".join(["before"] * (13 * k)) + "\n(" + " ".join(words).upper() + ") after " * 50
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = license_scan.license_matches(docs).collect()
    got = {(r.doc_id, r.template): round(r.containment, 9) for r in rows}
    assert got == plain_matches(texts, TEMPLATES)
    assert {k for k, _ in got} == set(texts)
    for r in rows:
        assert 0 <= r.first_word < r.last_word


def test_notices_of_a_few_words_are_found_in_long_texts(spark):
    before, after = "before " * 40, " after" * 60
    short = [("two", None, "no warranty"), ("four", None, "do not copy this")]
    texts = [
        (1, f"{before}\n(c) Someone. All rights reserved.{after}"), (2, f"{before}no, (Warranty){after}"),
        (3, f"{before}do not copy this"), (4, "all rights RESERVED"), (5, f"{before}all rights are reserved{after}"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = license_scan.license_matches(docs, templates=[*TEMPLATES, *short]).collect()
    assert {(r.doc_id, r.template, r.first_word, r.last_word) for r in rows} == {
        (1, "all-rights-reserved", 42, 44), (2, "two", 40, 41), (3, "four", 40, 43),
        (4, "all-rights-reserved", 0, 2),
    }


def test_bands_give_the_probability_asked_for():
    miss = (1 - license_scan.least_similarity()) ** license_scan.bands()
    assert miss <= 1 - license_scan.PROBABILITY


def test_license_scan_of_odd_rows(spark, odd, empty):
    assert license_scan.license_matches(odd).count() == 0
    assert license_scan.license_matches(empty).count() == 0
    assert license_scan.license_matches(odd, templates=()).count() == 0
    extra = [("t", None, "alpha beta gamma delta epsilon zeta"), ("none", None, " ")]
    rows = license_scan.license_matches(odd, templates=extra).collect()
    assert {r.doc_id for r in rows} == {7, 8, None}


def test_op7_equals_its_sql(spark, small):
    run, sql = entry_point.queries()["op7_exact_dedup"], entry_point.oracle_sql()["op7_exact_dedup"]
    assert compare(spark, duck(small), run, sql, small) is None


def test_dedup_does_not_depend_on_the_batches(docs):
    one = sorted(exact_dedup.exact_dedup(docs, batches=1).collect())
    assert one == sorted(exact_dedup.exact_dedup(docs, batches=5).collect())


def test_index_outlives_the_job(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/digest-index"
    rows = exact_dedup.digests(docs)
    index = exact_dedup.DigestIndex(spark, folder, 4)
    index.append(rows.where("doc_id < 100"))
    index.drop()
    again = exact_dedup.DigestIndex(spark, folder, 4)
    assert again.unseen(rows.where("doc_id < 100")).count() == 0
    again.append(rows)
    kept = {(bytes(r.digest), r.keep_id) for r in again.rows().collect()}
    want = {(bytes(r.digest), r.m) for r in rows.groupBy("digest").agg({"doc_id": "min"}).toDF("digest", "m").collect()}
    assert kept == want
    plan = again.unseen(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_dedup_of_odd_rows(odd, empty):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == odd.count()
    same = [r for r in rows if r.doc_id in (7, 8)]
    assert len(same) == 3 and all((r.keep_id, r.group_size) == (7, 4) for r in same)
    assert sum(r.kept for r in same) == 2
    nulls = [r for r in rows if r.doc_id in (1, 2)]
    assert all((r.keep_id, r.group_size) == (1, 3) for r in nulls)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_texts_are_measured_once_for_what_the_rules_keep(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = quality_rules.keep_good(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
