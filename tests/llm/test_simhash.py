from __future__ import annotations

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphweave.llm.components import components
from glyphweave.llm.fingerprint import fingerprints, xxh64_rows
from glyphweave.llm.simhash import links, near_dedup


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBcÉß \t\n\x0b-.,", max_size=90)), max_size=6))
def test_fingerprints(texts):
    assert fingerprints(texts).tolist() == [plain(t) for t in texts]


def test_hashes_of_every_short_length():
    for n in range(1, 32):
        rows = np.random.default_rng(n).integers(0, 256, (5, n)).astype(np.uint8)
        assert xxh64_rows(rows).tolist() == [xxhash.xxh64_intdigest(r.tobytes(), 42) for r in rows]


def test_a_long_text_is_whole():
    text = " ".join(f"w{k}" for k in range(150_000))
    assert fingerprints([text, text + " end"]).tolist() == [plain(text), plain(text + " end")]


def pairs(values):
    return {(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}


def test_links_against_all_pairs(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(6):
            y = x
            for _ in range(rng.randint(1, 5)):
                y ^= 1 << rng.randrange(64)
            values.add(y)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values | {0, 1, 3, 7, 15, 2**64 - 1})
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    assert got == pairs(values)


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(30)] + [(300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100: 100}, **{200 + k: 100 for k in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes(spark):
    base = " ".join(f"word{k}" for k in range(300))
    rows = [(5, base), (3, base + " tail"), (9, base), (4, "quite another text of a few words"), (1, ""), (2, None), (8, " \n"), (None, base), (7, "lone")]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, fp int, root string")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in near_dedup(docs).collect()]
    assert len(got) == len(rows)
    prints = [(i, plain(t)) for i, t in rows]
    near = lambda a, b: bin(a ^ b).count("1") <= 3
    want = []
    for i, f in prints:
        reach = {f}
        while True:
            more = {g for _, g in prints if any(near(g, h) for h in reach)}
            if more == reach:
                break
            reach = more
        want.append((i, f"{f:016x}", min(j for j, g in prints if g in reach and j is not None)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert near_dedup(docs.filter("false")).count() == 0


def test_many_copies_are_one_node(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same few words here").alias("text"))
    assert near_dedup(docs).groupBy("component_id").count().collect()[0][:] == (0, 4000)
