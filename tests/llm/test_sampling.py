from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphweave.llm import sampling
from glyphweave.llm.sampling import MODEL, Lattice, row_key, sample_encode


@pytest.fixture(scope="module")
def net():
    return Lattice(MODEL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_lossless(texts):
    found = sampling.lattice(MODEL, 1.0).encode(texts, list(range(len(texts))))
    assert [sampling.lattice(MODEL, 1.0).decode(x) for x in found] == texts


def test_lossless_on_hard_texts(net):
    texts = ["▁▁ a ▁b", "  two   spaces ", "\n\ttab\x00nul", "é́😀 漢字 ไทย", "x" * 40_000, "a b " * 20_000, "<s></s><unk><0x41>", " "]
    for x, t in zip(net.encode(texts, [0] * len(texts)), texts, strict=True):
        assert net.decode(x) == t and x.max(initial=0) < 32_000


def ways(net, word):
    """Every segmentation of a word into pieces, with its weight."""
    if not word:
        return [((), 1.0)]
    out = []
    for k in range(1, len(word) + 1):
        if word[:k] in net.weight:
            w, i = net.weight[word[:k]]
            out += [((i, *rest), w * v) for rest, v in ways(net, word[k:])]
    return out


def test_draws_follow_the_lattice(net):
    for word in (" the", "house", " within"):
        n = 40_000
        drawn = Counter(tuple(x.tolist()) for x in net.encode([word] * n, [row_key(k) for k in range(n)]))
        all_ways = ways(net, word)
        total = sum(w for _, w in all_ways)
        assert set(drawn) <= {s for s, _ in all_ways}
        for s, w in all_ways:
            p = w / total
            assert abs(drawn[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_places_draw_apart_and_keys_repeat(net):
    text = "house house house house house house house house"
    a, b, c = net.encode([text, text, text], [1, 1, 2])
    assert a.tolist() == b.tolist() != c.tolist()
    parts = net.encode([" house"] * 3, [5, 6, 7])
    assert all(net.decode(p) == " house" for p in parts)


def test_the_cache_changes_nothing(monkeypatch):
    texts = [f"word{k} and word{k + 1}" for k in range(300)]
    keys = list(range(300))
    whole = Lattice(MODEL).encode(texts, keys)
    monkeypatch.setattr(sampling, "HELD_WORDS", 5)
    small = Lattice(MODEL)
    got = [small.encode([t], [k])[0] for t, k in zip(texts, keys, strict=True)]
    assert all(np.array_equal(x, y) for x, y in zip(whole, got, strict=True))


def test_rows(spark):
    rows = [(1, "some text"), (1, "some text"), (None, "some text"), (2, None), (3, ""), (4, "word " * 100_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    got = sample_encode(docs).collect()
    assert len(got) == 6 and all(r.lossless and r.n_ids == len(r.ids) for r in got)
    assert len({tuple(r.ids) for r in got if r.doc_id == 1}) == 1
    again = sample_encode(docs.repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in got) == sorted((r.doc_id or 0, r.ids_crc32) for r in again)
    assert sample_encode(docs.filter("false")).count() == 0
