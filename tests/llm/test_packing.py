import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import packing
from rankloom.llm.queries import tokenizer_path


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(packed, docs, capacity):
    """Every piece of every document once, full but the first, gapless in its sequence."""
    ids = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids[r["doc_id"]].append(library_ids([r["text"]])[0])
    rows = packed.collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for doc, copies in ids.items():
        want = []
        for x in copies:
            for n, (start, length) in enumerate(packing.cut(len(x), capacity)):
                want.append((n, start, length, zlib.crc32(np.asarray(x[start : start + length], "<u4").tobytes())))
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[doc]) == sorted(want)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(r["length"] for r in rows)


def test_whole_table(documents):
    sequences, tokens = check(packing.pack_documents(documents, tokenizer_path()), documents, packing.CAPACITY)
    assert sequences <= -(-tokens // packing.CAPACITY) * 1.01 + 1


def test_odd_rows(odd_docs, no_docs):
    check(packing.pack_documents(odd_docs, tokenizer_path(), capacity=64, shard_pieces=500), odd_docs, 64)
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


def test_sequences_hold_the_ids(documents):
    docs = documents.limit(20)
    packed = packing.pack_documents(docs, tokenizer_path(), capacity=256, with_ids=True)
    tokens = {r["sequence_id"]: r["tokens"] for r in packing.sequences(packed).collect()}
    texts = {r["doc_id"]: library_ids([r["text"]])[0] for r in docs.collect()}
    for r in packed.collect():
        got = tokens[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert got == texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]


def test_words_apart_give_the_library_ids():
    with open(tokenizer_path(), encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    texts = ["", " ", "a  b\n\n c's \t x", "Ünï cödé_12 ½ ² x² 日本", "it's  don't\r\n  ", "x y    z", "<|endoftext|> 1.2.3 __a__"]
    for t, want in zip(texts, library_ids(texts)):
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == want[:-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 6))
def test_best_fit_against_a_plain_list(lengths, open_bins):
    fit, bins, closed = packing.BestFit(50, open_bins), {}, 0
    for n in lengths:
        sequence, offset = fit.place(n)
        fitting = [f for f in bins.values() if f >= n]
        if fitting:
            assert bins[sequence] == min(fitting)
        else:
            assert sequence not in bins and offset == 0
        left = bins.pop(sequence, 50) - n
        assert offset == 50 - n - left
        if left:
            bins[sequence] = left
        if len(bins) > open_bins:
            least = min(bins.values())
            gone = [s for s in bins if bins[s] == least and s not in {x for v in fit.at.values() for x in v}]
            assert len(gone) == 1
            bins.pop(gone[0])
            closed += 1
    assert fit.open == len(bins)


@pytest.mark.parametrize("length,want", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)])])
def test_cut(length, want):
    assert packing.cut(length, 8) == want


def test_a_text_with_the_tokenizers_own_token(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "plain words")], "doc_id bigint, text string")
    check(packing.pack_documents(docs, tokenizer_path(), capacity=3), docs, 3)
    assert 50256 in library_ids(["a <|endoftext|> b"])[0]


@pytest.fixture(scope="module")
def encoder():
    with open(tokenizer_path(), encoding="utf-8") as f:
        return packing.Encoder(f.read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", "é", "ſ", "'s", "'", ".", " ", "  ", "\n", "\n\n", "\t", "\r", "12", "_", "don't", "日", "\x7f"]), max_size=14))
def test_any_mix_of_words_and_white_space(encoder, parts):
    text = "".join(parts)
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want


def test_words_beyond_the_memory_are_the_same(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 2000)
    with open(tokenizer_path(), encoding="utf-8") as f:
        small = packing.Encoder(f.read())
    texts = [" ".join(f"word{k % n}." for k in range(60)) for n in (3, 50, 60)]
    for t, want in zip(texts, library_ids(texts)):
        assert np.frombuffer(small.ids(t), "<u4").tolist() == want[:-1]
    assert small.room < 0
