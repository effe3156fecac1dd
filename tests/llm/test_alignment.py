"""Token alignment against offsets worked out token by token."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlake.llm import alignment
from ledgerlake.llm.common import kept
from tests.conftest import SF_SMALL

ODD = [None, "", "  ", "<|endoftext|> x<s>y</s>", "\x00\x01 a\x1cb", "İstanbul ΣΑΣ", "▁a", "<0x41>", "日本語 テスト😀", "​ ﻿",
       "x" * 3000, "\r\nab\tcd", " " * 3000, "é" * 900]


@pytest.fixture(scope="module")
def brute():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain}
    byte.update({chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)})
    spell = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab().items() if i != 50256}

    def of(text):
        none = (0, 0, 0, 0, "", Counter())
        if not text:
            return none
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bx = [spell[i] for i in x]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
              for i in y]
        if any(b"".join(z) != (" " + text).encode() for z in (bx, by)):
            return none
        ends_x, ends_y = np.cumsum([len(z) for z in bx]), np.cumsum([len(z) for z in by])
        cut = sorted(set(ends_x.tolist()) & set(ends_y.tolist()))
        gx, gy = defaultdict(list), defaultdict(list)
        for i, g in zip(x, np.searchsorted(cut, ends_x)):
            gx[g].append(i)
        for i, g in zip(y, np.searchsorted(cut, ends_y)):
            gy[g].append(i)
        links = Counter()
        for g in gx:
            cx, cy = Counter(gx[g]), Counter(gy[g])
            for i, n in cx.items():
                for j, m in cy.items():
                    links[i << 16 | j] += n * m
        told = ";".join(",".join(map(str, gx[g])) + "|" + ",".join(map(str, gy[g])) for g in range(len(cut)))
        return len(x), len(y), len(cut), links.total(), hashlib.sha256(told.encode()).hexdigest(), links
    return of


def same(text, got, want):
    links = dict(zip(np.frombuffer(got[6], "<u4").tolist(), alignment.unpacked(got[7], len(got[6]) // 4).tolist()))
    assert (*got[:4], got[5]) == want[:5], text
    assert links == dict(want[5]), text


def test_odd_texts(brute):
    texts = [t or "" for t in ODD]
    for text, got in zip(texts, alignment._public()(texts)):
        same(text, got, brute(text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_any_texts(brute, texts):
    for text, got in zip(texts, alignment._public()(texts)):
        same(text, got, brute(text))


def test_counts_over_the_corpus(spark, brute):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    held = Counter(k for w in want.values() for k in w[5])
    most = defaultdict(int)
    for k, n in held.items():
        most[k >> 16] = max(most[k >> 16], n)
    expected = {i: (*w[:4], sum(n for k, n in w[5].items() if held[k] == most[k >> 16]),
                    sum(n * held[k] for k, n in w[5].items()), w[4]) for i, w in want.items()}
    got = alignment.op13_alignment(spark, SF_SMALL)
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
            for r in got.collect()} == expected
    # many broadcasts give the same sums as one
    aligned = kept(alignment.align_documents(docs, alignment._public))
    some = alignment.scored(aligned, alignment.pair_counts(aligned), 900)
    assert {r.doc_id: (r.n_best, r.count_sum) for r in some.collect()} == {i: e[4:6] for i, e in expected.items()}


def test_edge_rows_and_empty_table(make, brute, edge_rows):
    aligned = kept(alignment.align_documents(make(edge_rows), alignment._public))
    got = alignment.scored(aligned, alignment.pair_counts(aligned)).collect()
    assert Counter((r.doc_id, r.n_a, r.n_links) for r in got) == Counter(
        (i, brute(t)[0], brute(t)[3]) for i, t, *_ in edge_rows)
    aligned = kept(alignment.align_documents(make([]), alignment._public))
    assert alignment.scored(aligned, alignment.pair_counts(aligned)).count() == 0


def test_products_in_blocks_equal_dense_products():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 2, (30, 20)), r.integers(0, 2, (20, 25))

    def csr(m):
        return np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1]
    for most in (1, 40, 10_000):
        dense = np.zeros((30, 25), int)
        for row, column, times in alignment.products(*csr(a), *csr(b), most=most):
            dense[row, column] += times
        assert (dense == a @ b).all()


def test_overlap_links_are_the_bytes_shared(make):
    rows = alignment.overlap_links(make([(1, "Überlap, two words", "de", "s"), (2, None, "de", "s")]),
                                   alignment._public).collect()
    assert sum(r.bytes_shared for r in rows) == len(" Überlap, two words".encode())
    assert {r.doc_id for r in rows} == {1}
