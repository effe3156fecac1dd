"""Packing: law of the pieces, ids against the tokenizer, differencing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlake.llm import packing
from tests.llm.conftest import prose

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "À É. ªº ß, µm. Ångström..", " ́abc", "<|endoftext|> x<|startoftext|>y", "\x00\x01 a\x1cb",
       "İstanbul ΣΑΣ", "a b　c", "it's don't 12345 .,", "日本語 テスト", "​", "x" * 5000, "\r\nab\tcd", "DON'T Stop. STOP."]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_remembered_words_give_the_tokenizers_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 40)
    texts = ODD + [prose(200, s, 60) for s in range(5)] + ODD
    ids = packing.WordIds(PATH)
    for _ in range(2):
        for text, got in zip(texts, ids(texts)):
            assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


MARKED = ["heat*** are.%%% Reshsh,### x''s it's.. don't_ a_b_ É.,É é<| A<|endoftext|>.. <|ENDOFTEXT|> <|EndOfText|>a",
          "ÀÉ ÷× µM ªº", "ABC Abc abc. ABC, aBc;'s \x85A\xa0B \xadC", "A1. 1A. _A A_ ''", "ΑΒΓ. ABC ÿŸ"]


def test_marks_and_capitals(tokenizer, monkeypatch):
    apart = []
    ids = packing.WordIds(PATH)
    for text, got in zip(MARKED, ids(MARKED)):
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    # words that differ by capitals or marks alone cost the tokenizer one word of letters
    monkeypatch.setattr(ids, "_joined", lambda words, joined=ids._joined: apart.extend(words) or joined(words))
    list(ids(["Zebrafish zebrafish*** ZEBRAFISH.%%% zebrafish"]))
    assert apart == ["zebrafish"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aAéÉsSΣßİ '.,*<|>_1\n\u0301\x85", max_size=30), max_size=4))
def test_any_text_of_marks(texts):
    ids, tokenizer = packing._word_ids(PATH), Tokenizer.from_file(PATH)
    assert [x.tolist() for x in ids(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(texts):
    ids, tokenizer = packing._word_ids(PATH), Tokenizer.from_file(PATH)
    assert [x.tolist() for x in ids(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def lawful(rows, docs, tokenizer, capacity=4096):
    """Every id lies in one piece, pieces lie side by side in their sequence."""
    want = sorted((str(i), *tokenizer.encode(t or "", add_special_tokens=False).ids, 2) for i, t in docs)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(str(r.doc_id), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for r in by_seq.values():
        at = 0
        for p in sorted(r, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
    assert sorted(by_seq) == list(range(len(by_seq)))
    lengths = sorted((w[0], len(w) - 1) for w in want)
    assert sorted((str(p.doc_id), p.doc_tokens) for r in by_doc.values() for p in r if p.start == 0) == lengths
    return by_doc, by_seq, want


def test_pieces_of_documents(make, tokenizer):
    r = random.Random(5)
    docs = [(i, prose(r.randrange(0, 900), i, 3000)) for i in range(300)] + [(300, prose(30_000, 300, 3000))]
    got = packing.pack(packing.pieces(make([(i, t, "en", "s") for i, t in docs]).repartition(5), PATH)).collect()
    by_doc, by_seq, want = lawful(got, docs, tokenizer)
    for name, *ids in want:
        parts = sorted(by_doc[name], key=lambda p: p.start)
        assert [p.start for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())
    total = sum(p.length for p in got)
    assert len(by_seq) * 4096 < 1.03 * total + 4096


def test_edge_rows(make, tokenizer, edge_rows):
    docs = [(r[0], r[1]) for r in edge_rows]
    lawful(packing.pack(packing.pieces(make(edge_rows), PATH)).collect(), docs, tokenizer)
    assert packing.pack(packing.pieces(make([]), PATH)).count() == 0


def test_sequences_hold_the_ids(make, tokenizer):
    docs = [(i, prose(50 + i, i)) for i in range(40)]
    packed = packing.pack(packing.pieces(make([(i, t, "en", "s") for i, t in docs]), PATH, with_ids=True))
    seq = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in packing.token_sequences(packed).collect()}
    for p in packed.collect():
        ids = [*tokenizer.encode(dict(docs)[p.doc_id], add_special_tokens=False).ids, 2]
        assert seq[p.sequence_id][p.offset:p.offset + p.length].tolist() == ids[p.start:p.start + p.length]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60), st.integers(1, 9))
def test_differencing_is_a_near_equal_partition(sizes, k):
    found = packing.differencing(np.array(sizes), k)
    sums = np.bincount(found, weights=sizes, minlength=k)
    assert len(found) == len(sizes) and found.max() < k
    assert sums.max() - sums.min() <= max(sizes)


def test_differencing_of_a_known_case():
    # two windows: 8,7,6,5,4 end 16 and 14 by largest differencing
    sums = np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])
    assert sorted(sums) == [14, 16]


def test_the_count_of_windows_rises():
    found, k = packing.windows(np.array([60, 60, 60]), 100)      # two windows would hold 180 tokens
    assert k == 3 and sorted(found) == [0, 1, 2]
