from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glyphweave.llm.packing import CAPACITY, VOCABULARY, cuts, encoder, pack


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(reference):
    @settings(max_examples=400, deadline=None)
    @given(st.text(max_size=80))
    def same(text):
        assert encoder(VOCABULARY)(text) == reference(text)

    same()


def test_ids_of_every_character(reference):
    encode = encoder(VOCABULARY)
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 4096):
        for glue in ("", " ", "a", "7 "):
            text = glue.join(chars[k : k + 4096])
            assert encode(text) == reference(text)
    for text in ("<|endoftext|>", "a<|endoftext|> b", "can't we'll  \n\n x\t\t", " é  ü 12 3½", "   "):
        assert encode(text) == reference(text)


def test_cuts():
    for n in range(1, 5000):
        found = cuts(n)
        assert sum(x for x, _ in found) == n
        assert all(k * x <= CAPACITY and CAPACITY - k * x <= max(4, k - 1) for x, k in found)


def texts(spark):
    words = "alpha beta gamma delta Ünïcode 12,345 ".split()
    rows = [(k, " ".join(words[(k * 7 + j) % len(words)] for j in range((k * 37) % 900))) for k in range(400)]
    rows += [(1000, None), (1001, ""), (1001, ""), (None, "no id"), (2000, "long " * 60_000)]
    return rows, spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, worker int").repartition(7)


def check(rows, pieces, reference, capacity=CAPACITY):
    docs = {}
    for p in pieces:
        docs.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append([*reference(t or ""), 0])
    for (i, n), found in docs.items():
        ids = np.array(by_id[i][0], dtype="<u4")
        assert len(ids) == n
        copies = len(by_id[i])
        at = 0
        for p in sorted(found, key=lambda p: p.start)[::copies]:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == n
    assert sum(p.length for p in pieces) == sum(len(x) for v in by_id.values() for x in v)
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    used = [sum(n for _, n in b) for b in bins.values()]
    return sum(0 if u & (u - 1) == 0 else capacity - u for u in used) / sum(used)


def test_pieces_and_padding(spark, reference):
    rows, docs = texts(spark)
    assert check(rows, pack(docs).collect(), reference) < 0.02


def test_a_tree_of_workers(spark, reference):
    rows, docs = texts(spark)
    assert check(rows, pack(docs, tree=2).collect(), reference) < 0.02


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
