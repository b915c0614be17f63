"""Aligned tokens against the tokenizer libraries and a merge by plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
from fleetveil.llm import alignment, bpe, token_counts
from test_tokens import random_texts

PATHS = bpe.vocabulary_path(), bpe.vocabulary_path(token_counts.MODEL)
SIZE_B = 32_000


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def library_tokens(text, libraries):
    """(ids, their bytes) by A and B, or nothing where the bytes are not blank and text."""
    a, b = libraries
    if not text:
        return None
    letters = bpe._byte_letters()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text, num_threads=1)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [
        bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        for i in ids_b
    ]
    whole = (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None


def plain_alignment(texts, libraries):
    """For each text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    done, counts = [], Counter()
    for text in texts:
        coded = library_tokens(text, libraries)
        if coded is None:
            done.append(None)
            continue
        ids_a, bytes_a, ids_b, bytes_b = coded
        of = []
        for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
            spans, at = [], 0
            for i, part in zip(ids, parts):
                spans.append((i, at, at + len(part)))
                at += len(part)
            of.append(spans)
        links, j = [], 0
        for x, s, e in of[0]:
            while of[1][j][2] <= s:
                j += 1
            k = j
            while k < len(of[1]) and of[1][k][1] < e:
                links.append((x, of[1][k][0]))
                k += 1
        groups, group = [], ([], [])
        ends = {e for _, _, e in of[0]} & {e for _, _, e in of[1]}
        tokens = sorted([(e, 0, x) for x, _, e in of[0]] + [(e, 1, x) for x, _, e in of[1]])
        for e, side, x in tokens:
            group[side].append(str(x))
            if side == 1 and e in ends:
                groups.append("|".join(",".join(g) for g in group))
                group = ([], [])
        counts.update(links)
        done.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for row in done:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = row
        best = sum(counts[p] == most[p[1]] for p in links)
        out.append((n_a, n_b, n_groups, len(links), best, sum(counts[p] for p in links), groups))
    return out


def aligned(docs, steps, table):
    found = alignment.Alignment(docs, *PATHS, steps=steps)
    rows = found.documents.join(found.scores(table), "row").collect()
    return rows, Counter(
        (r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows
    )


def test_op12_equals_the_libraries(spark, small, texts, libraries):
    rows = entry_point.queries()["op12_alignment"](spark, small).collect()
    want = Counter(
        (i, *r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[0] else "")
        for i, r in zip(texts, plain_alignment(texts.values(), libraries))
    )
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[c] for c in names) for r in rows) == want


@pytest.mark.parametrize("steps,table", [(1, 0), (2, 50), (5, 1 << 19), (64, 300), (1 << 15, 20)])
def test_pieces_and_tables_of_any_size(spark, libraries, steps, table):
    texts = random_texts(250, steps) + ["the cat sat " * 40, "a" * 300, "▁", "</s><s> <|endoftext|>x", "\x00 a"]
    texts += ["Ünïcödé 中文字 words😀 with  gaps\n and\tmore ", " led", "trailing ", "two\n\nlines\n x"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter((i, *r) for i, r in enumerate(plain_alignment(texts, libraries)))
    assert aligned(docs, steps, table)[1] == want


def test_alignment_of_odd_rows(odd, empty, libraries):
    source = odd.collect()
    want = Counter(
        (r.doc_id, *a) for r, a in zip(source, plain_alignment([r.text for r in source], libraries))
    )
    rows, got = aligned(odd, 1 << 12, 1 << 19)
    assert got == want and len({r.row for r in rows}) == len(source)
    assert aligned(empty, 100, 100)[0] == []


def test_merge_path_cuts_equal_pieces():
    rng = random.Random(2)
    for _ in range(300):
        a = np.unique([rng.randrange(60) for _ in range(rng.randint(0, 40))])
        b = np.unique([rng.randrange(60) for _ in range(rng.randint(0, 40))])
        steps = rng.randint(1, 9)
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        cuts = alignment.merge_path(a, b, steps)
        for k, i in enumerate(cuts):
            d = min(k * steps, len(merged))
            assert i == sum(side == 0 for _, side in merged[:d])
        assert len(cuts) == -(-len(merged) // steps) + 1
