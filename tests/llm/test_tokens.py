"""Encoding, token counts and packing against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
from fleetveil.llm import bpe, packing, token_counts

LETTERS = list("abcdeeettt aaa  \n\n\t\r'sSll.,!?123½²Ⅷ_éßñçö  \x1c\x85中文字😀𝒳▁") + [
    "<|endoftext|>", " the", "'ll", "'re", "​", "     ", "a" * 16, "----", "</s>", "<0x41>",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(
        model_file=bpe.vocabulary_path(token_counts.MODEL)
    )


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(LETTERS, k=rng.randint(0, 40))) for _ in range(n)]


def test_encoder_equals_the_library_on_random_texts(library):
    own = bpe.load(bpe.vocabulary_path())
    for text in random_texts(4000, 1) + ["ab" * 20_000 + "x" * 10_000]:
        ids = own.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_fast_tokenizer_of_packing_equals_the_library(library):
    fast = packing.tokenizer(bpe.vocabulary_path())
    for text in random_texts(3000, 2):
        want = library.encode(text, add_special_tokens=False).ids
        assert fast.encode(text, allowed_special="all") == want, repr(text)


def test_op4_equals_the_library(spark, small, texts, library):
    rows = entry_point.queries()["op4_bpe_roundtrip"](spark, small).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bytes_that_are_no_text_are_replaced(library):
    own = bpe.load(bpe.vocabulary_path())
    ids = np.frombuffer(own.encode("😀é"), "<u4")[:1]
    assert own.decode(ids.tobytes()) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_encoding_of_odd_rows(odd, empty, library):
    path = bpe.vocabulary_path()
    rows = bpe.decode_documents(bpe.encode_documents(odd, path), path).collect()
    want = Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert Counter((r.doc_id, r.decoded) for r in rows) == want
    assert bpe.encode_documents(empty, path).count() == 0


def test_transducer_equals_the_library_however_a_text_is_cut(pieces):
    own = token_counts.load(bpe.vocabulary_path(token_counts.MODEL))
    rng = random.Random(3)
    for text in random_texts(3000, 4):
        want = len(pieces.encode(text))
        assert own.count(text) == want, repr(text)
        width = rng.randint(1, 12)
        state, total = None, 0
        for k in range(0, max(1, len(text)), width):
            head, synced, inner, end = own.chunk(text[k : k + width], k == 0)
            if head:
                total += own.resume(state, head)
                at = own.run(own.number(token_counts.pickle.loads(state)), head)[0]
                state = token_counts.pickle.dumps(own.states[at])
            if synced:
                total, state = total + inner, end
        assert total == want, repr(text)


def test_paths_through_text_without_blanks_meet(pieces):
    """Chunks without a synchronising point, from any state: the map equals reading them again."""
    own = token_counts.load(bpe.vocabulary_path(token_counts.MODEL))
    rng = random.Random(12)
    texts = ["a" * 4000, "ab" * 2500, "word" * 900, "the" * 700 + "x" + "the" * 700, "中文" * 1500]
    texts += ["".join(rng.choices("abcdefgh中文é\n", k=4000)) for _ in range(5)]
    for text in texts:
        for width in (97, 1000):
            total, state = 0, None
            for k in range(0, len(text), width):
                head, synced, inner, end = own.chunk(text[k : k + width], k == 0)
                assert synced == (k == 0)
                if synced:
                    total, state = total + inner, end
                else:
                    n, state = own.through(state, head, inner, end)
                    total += n
            assert total == len(pieces.encode(text)), text[:20]


def test_compiled_states_may_be_forgotten(pieces, texts, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_STATES", 50)
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 20)
    own = token_counts.Transducer(bpe.vocabulary_path(token_counts.MODEL))
    for text in list(texts.values())[:20]:
        assert own.count(text) == len(pieces.encode(text))


@pytest.mark.parametrize("chunk", [token_counts.CHUNK_CHARS, 61])
def test_counts_of_documents(docs, texts, pieces, chunk):
    path = bpe.vocabulary_path(token_counts.MODEL)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, path, 300, chunk).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        n = len(pieces.encode(text))
        assert (got[i].n_tokens, got[i].n_bytes) == (n, len(text.encode()))
        assert got[i].over_limit == (n > 300)


def test_counts_of_odd_rows(odd, empty, pieces):
    path = bpe.vocabulary_path(token_counts.MODEL)
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd, path, chunk_chars=1000).collect())
    want = Counter((r.doc_id, len(pieces.encode(r.text or ""))) for r in odd.collect())
    assert got == want
    assert token_counts.count_tokens(empty, path).count() == 0


def check_packing(rows, texts, library):
    """Every id in exactly one piece, sequences gapless and within the window."""
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
    assert by_doc.keys() == ids.keys()
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and len({r.step_group for r in parts}) == 1
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding, len(by_sequence)


def test_op1_packs_every_id_once_with_little_padding(spark, small, texts, library):
    rows = entry_point.queries()["op1_packing"](spark, small).collect()
    padding, _ = check_packing(rows, texts, library)
    assert padding <= 1024
    groups = defaultdict(int)
    for r in rows:
        groups[r.step_group] += r.length
    assert max(groups.values()) - min(groups.values()) <= 2 * 1024


def test_pools_carry_their_rest_on(docs, texts, library):
    packed = packing.pack_documents(
        docs.coalesce(1), bpe.vocabulary_path(), pool_tokens=5_000, step_tokens=2048
    ).selectExpr("*", "crc32(ids) AS ids_crc32")
    padding, _ = check_packing(packed.collect(), texts, library)
    assert padding <= 1024


def test_packing_of_odd_rows(odd, empty):
    rows = packing.packed_pieces(odd).collect()
    assert sum(r.start == 0 for r in rows) == odd.count()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1  # a null text is its end
    assert packing.packed_pieces(empty).count() == 0
    assert packing.pack_pool([], packing.TIERS, True) == ([], [])


def test_a_third_of_all_tokens_in_one_document(spark, library):
    texts = {0: "long text " * 20_000} | {i: f"short {i}" for i in range(1, 200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    padding, _ = check_packing(packing.packed_pieces(docs).collect(), texts, library)
    assert padding <= 1024
