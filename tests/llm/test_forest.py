from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from glyphweave.llm.forest import Forest, _route, _summary, exact_neighbours, hash_strings, search

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def table(spark, ids, x):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 0.5, 3) for i, v in zip(ids, x, strict=True)], SCHEMA)


def test_candidates_are_the_longest_prefixes():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((200, 16)), rng.standard_normal((5, 16))
    forest = Forest(x, trees=6, bits=12)
    codes, asked = hash_strings(x, 6, 12), hash_strings(q, 6, 12)
    for j in range(5):
        shared = np.array([[12 - int(c).bit_length() for c in codes[t] ^ asked[t, j]] for t in range(6)]).max(axis=0)
        for want in (1, 10, 60, 200):
            level = next((n for n in range(12, -1, -1) if (shared >= n).sum() >= want), 0)
            assert set(forest.candidates(asked[:, j], want)) == set(np.flatnonzero(shared >= level))


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    x[1000:1400] = x[0] + 0.05 * rng.standard_normal((400, 32))  # a crowd
    ids = np.arange(3000)
    got: dict[int, list] = {}
    for r in search(table(spark, ids.tolist(), x), lambda i: i % 50 == 0, vector_block=700, query_block=25).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact_neighbours(ids, x.astype(np.float64), np.flatnonzero(ids % 50 == 0))
    hits = 0
    for q, best in want.items():
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True)
        scores = dict(best)
        hits += sum(i in scores for _, i, _ in found)
        assert all(abs(scores[i] - s) < 1e-15 for _, i, s in found if i in scores)
    assert hits / (5 * len(want)) >= 0.9


def test_unsound_vectors_take_no_part(spark):
    x = [[1, 0], None, [], [0, 0], [1, None], [float("nan"), 1], [float("inf"), 1], [0, 1], [1, 1, 1], [2, 0]]
    got = search(table(spark, [0, *range(1, 8), 8, 50], x), lambda i: i % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert got[0].score == 1.0
    assert search(table(spark, [], []), lambda i: i % 50 == 0).count() == 0
    assert search(table(spark, [None], [[1, 1]]), lambda i: i % 50 == 0).count() == 0


def test_ties_go_to_smaller_ids_in_a_hot_group(spark):
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(-1.0), F.col("id") * 0.001)).alias("embedding"))
    got: dict[int, list] = {}
    for r in search(rows.union(rows.limit(4)), lambda i: i % 300 == 0, vector_block=500).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert all([i for _, i in sorted(v)] == [i for i in range(0, 18, 3) if i != q][:5] for q, v in got.items()) and len(got) == 10


def test_clustered_vectors(spark, monkeypatch):
    """High recall from few candidates and few blocks."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 32))
    x = (centres[rng.integers(0, 60, 6000)] + 0.25 * rng.standard_normal((6000, 32))).astype(np.float32)
    ids = np.arange(6000)
    forest = Forest(x.astype(np.float64))
    codes = hash_strings(x[:200].astype(np.float64))
    want = exact_neighbours(ids, x.astype(np.float64), ids[ids % 50 == 0])
    looked = [len(forest.sharing(codes[:, j], forest.level_for(want[j][-1][1], 0.97))) for j in range(0, 200, 50)]
    assert max(looked) < 900
    got: dict[int, set] = {}
    for r in search(table(spark, ids.tolist(), x), lambda i: i % 50 == 0, vector_block=400).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in best}) for q, best in want.items()) / (5 * len(want)) >= 0.95


def test_blocks_that_can_not_hold_a_nearer_vector_are_left_out():
    rng = np.random.default_rng(6)
    frame = lambda x, prefix: pd.DataFrame({"dims": 8, "prefix": prefix, "sub": 0, "embedding": list(x)})
    near, far = rng.standard_normal(8), rng.standard_normal(8)
    sets = [near + 0.05 * rng.standard_normal((50, 8)), far + 0.05 * rng.standard_normal((50, 8)), -near + 0.05 * rng.standard_normal((50, 8))]
    blocks = pd.concat([_summary(frame(x, p)) for p, x in enumerate(sets, 1)])
    queries = pd.DataFrame({"query_id": [1, 2], "query_key": ["a", "b"], "embedding": [near, far], "theta": [0.95, -1.0], "dims": 8, "prefix": [0, 1]})
    assert sorted(map(tuple, _route(queries, blocks)[["query_id", "prefix"]].itertuples(index=False))) == [(1, 1), (2, 2), (2, 3)]


def test_many_blocks_give_what_one_does(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 12)).astype(np.float32)
    docs = table(spark, list(range(1500)), x)
    rows = lambda **k: {(r.query_id, r.rank, r.vec_id) for r in search(docs, lambda i: i % 30 == 0, recall=1 - 1e-12, **k).collect()}
    assert rows() == rows(vector_block=100, query_block=7)
