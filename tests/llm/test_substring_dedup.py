from __future__ import annotations

import random

import numpy as np
import pytest

from glyphweave.llm import substring_dedup as sd
from glyphweave.llm.suffix import common_prefixes, found_in, suffix_array


def shared(b, x, y):
    k = 0
    while max(x, y) + k < len(b) and b[x + k] == b[y + k]:
        k += 1
    return k


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array_and_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(seed % 2, 2 + seed % 4, rng.integers(0, 250)).astype(np.uint8)
    if seed % 3 == 0 and len(data):
        data = np.tile(data[: max(1, len(data) // 9)], 11)
    b = data.tobytes()
    want = sorted(range(len(b)), key=lambda i: b[i:])
    sa = suffix_array(data)
    assert sa.tolist() == want
    assert common_prefixes(data, sa).tolist() == [0] * (len(b) > 0) + [shared(b, x, y) for x, y in zip(want, want[1:], strict=False)]


def test_binary_search():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 600).astype(np.uint8)
    starts = np.array([i for i in suffix_array(data) if i + 6 <= len(data)])
    needles = rng.integers(0, 3, (400, 6)).astype(np.uint8)
    hit, place = found_in(needles, data, starts, 6, block=37)
    have = [bytes(data[s : s + 6]) for s in starts]
    for k, n in enumerate(needles):
        assert hit[k] == (n.tobytes() in have) and place[k] == sum(h < n.tobytes() for h in have)


def test_windows_key_by_content():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 256, 900).astype(np.uint8)
    keys = []
    for n in (0, 77, 500):
        data = np.concatenate((rng.integers(0, 256, n), common, rng.integers(0, 256, 300))).astype(np.uint8)
        of = {}
        for s, e, key, _ in zip(*sd.regions(data, 400, 128), strict=True):
            of.update({p - n: key for p in range(s, e)})
        keys.append([of[p] for p in range(501)])
    assert keys[0] == keys[1] == keys[2]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, other = prose(120), prose(90)
    out = [(k, prose(rng.randint(1, 150))) for k in range(25)]
    out += [(100 + k, prose(rng.randint(0, 40)) + common + prose(rng.randint(0, 40))) for k in range(12)]
    out += [(200 + k, other[: 200 + 40 * k] + prose(10)) for k in range(10)]
    out += [(300 + k, out[3][1] * 2) for k in range(4)] + [(400, "And " * 300), (401, "ab" * 500), (402, "x" * 399), (403, "x" * 399), (404, "y" * 400), (405, "z" * 401)]
    out += [(500, None), (501, ""), (None, prose(100)), (502, common), (502, common), (503, common + common), (504, prose(90) * 3), (505, "\x00" * 900)]
    return out


ALL = [{}, {"key_regions": 2, "shard_bytes": 3000}, {"gram": 32, "key_regions": 5}, {"passage": 400, "gram": 128, "key_regions": 2}, {"key_regions": 1, "paired": 1}, {"key_regions": 3, "paired": 2, "shard_bytes": 1}]


@pytest.mark.parametrize("options", ALL)
def test_against_brute_force(spark, options):
    rows = corpus(4)
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, key int, t1 int, data string").repartition(5)
    got = sd.remove_repeats(docs, **options).drop("spans", "passages").collect()
    want = sd.brute_force(rows)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((None if i != i or i is None else int(i), int(n), int(r), int(s), h)) for i, n, r, s, h in want.itertuples(index=False))


@pytest.mark.parametrize("options", [{}, {"key_regions": 2}, {"key_regions": 1, "paired": 1}])
def test_passages_against_brute_force(spark, options):
    """Runs of over 50 words under strings of 256 bytes that stand in another row."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(3, 7))) for _ in range(n))
    line, short, mine = prose(60), prose(45), prose(70)
    rows = [(k, f"{prose(rng.randint(0, 60))} {line} {prose(rng.randint(0, 60))}") for k in range(9)]
    rows += [(10 + k, f"{prose(20)}\n{short}\n{prose(20)}") for k in range(5)] + [(20, f"{mine} {prose(30)} {mine}"), (21, None), (22, ""), (23, prose(200)), (24, prose(90)), (24, None)]
    rows += [(30, rows[0][1]), (31, mine[:200])]
    held: dict[bytes, set[int]] = {}
    for k, (_, t) in enumerate(rows):
        data = (t or "").encode()
        for at in range(len(data) - 255):
            held.setdefault(data[at : at + 256], set()).add(k)
    want = []
    for i, t in rows:
        data = (t or "").encode()
        runs = sd.covered([(at, at + 1) for at in range(len(data) - 255) if len(held[data[at : at + 256]]) > 1], 256)
        want.append((i, [(a, b) for a, b in runs if len(data[a:b].split()) > 50]))
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **options).collect()
    assert sorted((r.doc_id, [(x.start, x.end) for x in r.passages]) for r in got) == sorted(want)
    assert all(found for i, found in want if i < 9) and not any(found for i, found in want if 10 <= i < 30)


def test_chunks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 1500)
    rng = np.random.default_rng(9)
    data = rng.integers(0, 4, 9000).astype(np.uint8)
    data[7000:7800] = data[1200:2000]
    windows = sorted(p for s, e, _, _ in zip(*sd.regions(data, 400, 128), strict=True) for p in range(s, e))
    assert windows == list(range(8601))


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_worker_takes_few_rows_in_hand_and_no_large_tables():
    import pyarrow as pa

    texts = [f"{k:04d} " * 100 for k in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(range(600), pa.int64()), pa.array(texts)], ["t1", "t2", "text"])
    made = list(sd._key_windows(sd.PASSAGE, sd.GRAM)(iter([batch])))
    assert [len(set(b.column("t1").to_pylist())) for b in made] == [256, 256, 88]
    assert sd._UP.nbytes + sd._DOWN.nbytes < 5 << 20
