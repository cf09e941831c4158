import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, documents, empty

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrylight.llm import packing as P


#: The truth: the tokenizer as its file gives it.
TRUTH = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return np.array([*TRUTH.encode(text or "", add_special_tokens=False).ids, P.END_ID], "<u4")


CODER = P.ChunkTokenizer(P.TOKENIZER, bound=5000)


def check(rows, texts, window):
    """Round trip: every id in one piece, sequences gapless and not too long, checksums right."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for doc_id, own in pieces.items():
        copies = [ids_of(t) for i, t in texts if i == doc_id]
        for ids in copies[:1]:
            assert sum(p["length"] for p in own) == sum(map(len, copies))
            for p in own:
                assert zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    assert set(pieces) == {i for i, _ in texts}


def test_chunks_give_the_ids_of_the_text():
    texts = ["", "Hello, World!! don't it's", "É é É Straße ǅ ΣΑΣ İ ſ", "a\x1cb\x85c\xa0d　e", "<|endoftext|> x", "a <|endoftext|> b", "x<|endoftext|>y", "<|ENDOFTEXT|>", "A<|startoftext|><|endoftext|>b<|endoftext", "<|endoftext|>", "e<|endoftext|>\u0301", "½² 12,34 ...", "日本語 テスト", "x" * 3000]
    coder = P.ChunkTokenizer(P.TOKENIZER, bound=4)
    for _ in range(2):
        ids, ends = coder.encode(texts)
        begin = 0
        for t, e in zip(texts, ends, strict=True):
            assert ids[begin:e].tolist() == ids_of(t).tolist()
            begin = int(e)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aB 'st.,<|>\n")), max_size=30), st.sampled_from(["", "<|endoftext|>", " <|startoftext|>", "<|EndOfText|>"]), st.text(max_size=10))
def test_any_text_has_the_ids_of_the_tokenizer(a, special, b):
    try:
        (text := a + special + b).encode()
    except UnicodeEncodeError:
        return
    ids, _ = CODER.encode([text])
    assert ids.tolist() == ids_of(text).tolist()


def test_crc_of_rest():
    data = bytes(range(256)) * 9
    for cut in (0, 1, 100, len(data)):
        assert P.crc_of_rest(zlib.crc32(data), zlib.crc32(data[:cut]), len(data) - cut) == zlib.crc32(data[cut:])


@pytest.mark.parametrize("lengths", [[300] * 500, list(np.random.default_rng(0).integers(1, 513, 4000)), [1] * 7, [512] * 3, [257] * 1000 + [3] * 20])
def test_plan_spends_the_histogram(lengths):
    plan = P.solve(np.bincount(lengths, minlength=513))
    assert plan.sequences <= -(-sum(lengths) // 512) + 3


def test_least_squares():
    columns = P.combinations(8, np.array([1, 2, 3, 4, 5]))
    assert {tuple(c) for c in columns} == {(4, 4, 0), (5, 3, 0), (4, 3, 1), (4, 2, 2), (3, 3, 2), (5, 2, 1)}
    target = np.array([0, 0, 0, 50, 20, 50, 0, 0, 0.0])
    x = P.nonnegative_least_squares(columns, target)
    assert (x >= 0).all()
    spent = np.zeros(9)
    for c, v in zip(columns, x, strict=True):
        for b in c:
            spent[b] += v
    assert np.abs(spent[1:] - target[1:]).max() < 1


def test_round_trip_with_cuts(spark):
    texts = [(i, " ".join(["word"] * n)) for i, n in enumerate([39] * 40 + [5, 6, 7, 64, 63, 65, 200, 0])]
    rows = P.pack_documents(documents(spark, texts), window=64, unit=4).collect()
    check(rows, texts, 64)
    assert any(r["start"] % 64 for r in rows)
    used = len({r["sequence_id"] for r in rows})
    assert used <= -(-sum(len(ids_of(t)) for _, t in texts) // 60) + 2


def test_awkward(spark):
    docs = awkward(spark)
    rows = P.pack_documents(docs).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], P.WINDOW)
    assert P.pack_documents(empty(spark)).count() == 0
