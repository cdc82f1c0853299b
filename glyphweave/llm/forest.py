"""Approximate nearest neighbours by a hash-prefix forest.

A tree is a sorted array of long hash strings, one bit a random hyperplane. A query descends every
tree to its longest-prefix matches and then ascends all trees together, one bit at a time; each step
back widens the range of the sorted array that shares the prefix. First it ascends until FIRST
candidates are found; their scores tell how near the k-th is, and so how short a prefix must be for a
neighbour as near to share it in some tree with probability RECALL. There the ascent ends: after a few
candidates where neighbours are close, after many where no prefix tells them apart. Nothing is a share
of the data, and no query loses an answer because its neighbourhood is crowded.

Vectors are dealt into blocks by the first bits of their string in the first tree, crowded prefixes
into several, each with a forest, a centre and the largest angle to it. A query is searched in the
blocks of its own prefix first. Another block is searched only if its centre and radius leave room for
a vector nearer than the k-th found: on clustered data few are, whatever their number. Candidates are
scored exactly, in double precision, and answers merged by query.

Equal vectors are one entry that keeps its smallest ids: of equal scores the smaller id comes first,
so k + 1 of them are all that a query can ever return.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import salted_join, stage, table

K = 5
TREES = 96
BITS = 24
#: Candidates from which the k-th nearest is first told, and the probability with which one as near is met.
FIRST = 64
RECALL = 0.9
#: Target vectors and queries of a block.
VECTOR_BLOCK = 16_384
QUERY_BLOCK = 4_096
#: Summaries of blocks that are held against a block of queries at once.
SUMMARY_BLOCK = 4_096
SEED = 7

FOUND = "query_key string, query_id long, vec_id long, score double"


def hash_strings(x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """(trees, n) uint32 hash strings, first bit highest; planes depend on seed and dimension alone."""
    rng = np.random.default_rng(seed)
    powers = (1 << np.arange(bits - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
    out = np.empty((trees, len(x)), dtype=np.uint64)
    for t in range(trees):
        out[t] = ((x @ rng.standard_normal((x.shape[1], bits)) > 0) * powers).sum(axis=1, dtype=np.uint64)
    return out


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.trees, self.bits, self.n = trees, bits, len(vectors)
        codes = hash_strings(vectors, trees, bits)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def candidates(self, codes: np.ndarray, want: int) -> np.ndarray:
        """Positions of at least `want` vectors (all, if fewer) for a query's hash strings, one a tree."""
        if want >= self.n:
            return np.arange(self.n)
        depth = self._descend(codes)
        for level in range(int(depth.max()), -1, -1):
            found = self.sharing(codes, level, depth)
            if len(found) >= want:
                break
        return found

    def sharing(self, codes: np.ndarray, level: int, depth: np.ndarray | None = None) -> np.ndarray:
        """Positions of the vectors that share `level` bits or more with a query in some tree."""
        if level <= 0:
            return np.arange(self.n)
        seen = np.zeros(self.n, dtype=bool)
        shift = np.uint64(self.bits - level)
        for t in range(self.trees) if depth is None else np.flatnonzero(depth >= level):
            low = (codes[t] >> shift) << shift
            lo, hi = np.searchsorted(self.sorted[t], (low, low + (np.uint64(1) << shift)), "left")
            seen[self.order[t, lo:hi]] = True
        return np.flatnonzero(seen)

    def level_for(self, cosine: float, recall: float) -> int:
        """The longest prefix that a vector at this cosine shares with the query in some tree, with probability `recall`."""
        agree = 1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi
        in_one = 1 - (1 - recall) ** (1 / self.trees)
        if agree >= 1:
            return self.bits
        return min(self.bits, int(math.log(in_one) / math.log(agree))) if agree > 0 else 0

    def _descend(self, codes: np.ndarray) -> np.ndarray:
        """Length of the longest prefix that each tree shares with the query."""
        out = np.zeros(self.trees, dtype=np.int64)
        for t in range(self.trees):
            at = int(np.searchsorted(self.sorted[t], codes[t]))
            near = self.sorted[t, max(at - 1, 0) : at + 1] ^ codes[t]
            out[t] = max(self.bits - int(d).bit_length() for d in near.tolist())
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in column])


def _search(k: int, trees: int, bits: int, recall: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(vectors) and len(queries):
            vectors = vectors.sort_values("vec_id", kind="stable")
            x, q = _matrix(vectors["embedding"]), _matrix(queries["embedding"])
            length = np.sqrt((x * x).sum(axis=1))
            forest = Forest(x, trees, bits)
            codes = hash_strings(q, trees, bits)
            norm = np.sqrt((q * q).sum(axis=1))
            ids, first = vectors["ids"].tolist(), vectors["vec_id"].to_numpy()
            for j, (key, query_id, theta) in enumerate(zip(queries["query_key"], queries["query_id"], queries["theta"], strict=True)):
                found = forest.candidates(codes[:, j], FIRST)
                near = (x[found] @ q[j]) / (length[found] * norm[j])
                near = near[first[found] != query_id]
                kth = np.partition(near, -k)[-k] if len(near) >= k else -1.0
                found = np.union1d(found, forest.sharing(codes[:, j], forest.level_for(max(theta, float(kth)), recall)))
                # A matrix product finds who can be among the best; equal rows then get equal scores.
                rough = (x[found] @ q[j]) / length[found]
                if len(found) > k + 1:
                    floor = np.partition(rough, -(k + 1))[-(k + 1)]
                    found = found[rough >= floor - 1e-9 * (1 + abs(floor))]
                score = (x[found] * q[j]).sum(axis=1) / (length[found] * norm[j])
                best = sorted((-s, int(i)) for s, at in zip(score.tolist(), found.tolist(), strict=True) for i in ids[at] if i != query_id)
                out += [(key, query_id, i, -s) for s, i in best[:k]]
        return pd.DataFrame(out, columns=["query_key", "query_id", "vec_id", "score"])

    return run


def _prefixes(m: int, bits: int, seed: int = SEED) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the first m bits of their string in the first tree; the embedding is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(batch.num_columns - 1).to_pylist()
            prefix = np.zeros(len(vectors), dtype=np.int64)
            dims = np.array([len(v) for v in vectors], dtype=np.int64)
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng(seed).standard_normal((d, bits))[:, :m]
                at = np.flatnonzero(dims == d)
                hit = np.array([vectors[i] for i in at.tolist()]) @ planes[d] > 0
                prefix[at] = (hit * (1 << np.arange(m - 1, -1, -1, dtype=np.int64))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims.astype(np.int32)), pa.array(prefix)], [*batch.schema.names, "dims", "prefix"])

    return run


BLOCK = ["dims", "prefix", "sub"]


def _summary(rows: pd.DataFrame) -> pd.DataFrame:
    """The centre of a block's directions and the largest angle to it."""
    x = _matrix(rows["embedding"])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    centre = x.sum(axis=0)
    size = np.sqrt((centre * centre).sum())
    centre = centre / size if size > 0 else np.eye(1, x.shape[1])[0]
    radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
    return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in BLOCK}, "centre": [centre.tolist()], "radius": [radius]})


def _route(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks of other prefixes that may hold a vector nearer to a query than its k-th."""
    out = []
    if len(queries) and len(blocks):
        q, c = _matrix(queries["embedding"]), _matrix(blocks["centre"])
        q /= np.sqrt((q * q).sum(axis=1))[:, None]
        nearest = np.arccos(np.clip(q @ c.T, -1, 1)) - blocks["radius"].to_numpy()[None, :]
        open_ = (nearest <= np.arccos(np.clip(queries["theta"].to_numpy(), -1, 1))[:, None] + 1e-6) & (queries["prefix"].to_numpy()[:, None] != blocks["prefix"].to_numpy()[None, :])
        i, j = np.nonzero(open_)
        out = [queries.iloc[i][["query_id", "query_key", "embedding", "theta"]].reset_index(drop=True), blocks.iloc[j][BLOCK].reset_index(drop=True)]
    return pd.concat(out, axis=1) if out else pd.DataFrame(columns=["query_id", "query_key", "embedding", "theta", *BLOCK])


def search(
    rows: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, bits: int = BITS, recall: float = RECALL, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """The k nearest by cosine of each row for which is_query(id column) holds: query_id, rank, vec_id, score.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id,
    take no part. Vectors of different lengths are searched apart. A row is not its own neighbour, nor
    is any other with its id; repeated rows of an id count once. Ties go to the smaller id. With fewer
    than k candidates all are returned. Other columns are ignored.
    """
    v = F.col(vector_col).cast("array<double>")
    sound = F.aggregate(v, F.lit(True), lambda ok, c: ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    clean = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(sound, F.lit(False)) & F.exists("embedding", lambda c: c != 0)
    )
    clean = clean.withColumn("embedding", F.transform("embedding", lambda c: c + F.lit(0.0)))  # -0.0 equals 0.0
    # Equal vectors: ranks up to k + 1 are cut before the shuffle, so a vector held by many rows meets no single task.
    of_vector = Window.partitionBy("embedding").orderBy("vec_id")
    few = clean.withColumn("n", F.dense_rank().over(of_vector)).filter(F.col("n") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    distinct = stage(few.select(F.element_at("ids", 1).alias("vec_id"), "ids", "embedding"), "entries")
    total = distinct.count()
    m = max(0, min(bits, math.ceil(math.log2(max(1, total / vector_block)))))
    entries = stage(distinct.mapInArrow(_prefixes(m, bits), "vec_id long, ids array<long>, embedding array<double>, dims int, prefix long"), "entries")
    sizes = stage(entries.groupBy("dims", "prefix").agg(F.count(F.lit(1)).alias("n")).withColumn("subs", F.ceil(F.col("n") / vector_block)), "sizes")
    sub = F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int")
    entries = stage(salted_join(entries, sizes, ["dims", "prefix"], "n", total, F.xxhash64("vec_id", F.lit(1))).withColumn("sub", sub).select(*BLOCK, "vec_id", "ids", "embedding"), "entries")
    asked = clean.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.sha2(F.to_json("embedding"), 256).alias("query_key"), "embedding").distinct()
    asked = stage(asked.mapInArrow(_prefixes(m, bits), "query_id long, query_key string, embedding array<double>, dims int, prefix long"), "queries")
    query = ["query_id", "query_key"]
    of_query = Window.partitionBy(*query).orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(of_query)).filter(F.col("rank") <= k)

    def meet(pairs: DataFrame) -> DataFrame:
        """Search each query in each block that it is paired with; a block that many queries meet is met by a block of them at a time."""
        counts = pairs.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("q")).withColumn("parts", F.ceil(F.col("q") / query_block))
        held = entries.join(counts, BLOCK).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("q", "parts")
        part = F.pmod(F.xxhash64("query_id"), F.col("parts"))
        dealt = salted_join(pairs, counts, BLOCK, "q", pairs.count(), F.xxhash64("query_id", F.lit(1))).withColumn("part", part).drop("q", "parts")
        return held.groupBy(*BLOCK, "part").cogroup(dealt.groupBy(*BLOCK, "part")).applyInPandas(_search(k, trees, bits, recall), FOUND)

    own = salted_join(asked, sizes, ["dims", "prefix"], "n", total, F.xxhash64("query_id")).withColumn("sub", F.explode(F.sequence(F.lit(0), (F.col("subs") - 1).cast("int"))))
    first = stage(ranked(meet(stage(own.select(*query, "embedding", F.lit(-1.0).alias("theta"), *BLOCK), "pairs"))), "nearest")
    if m == 0:
        return first.select("query_id", "rank", "vec_id", "score")
    kth = first.filter(F.col("rank") == k).select(*query, F.col("score").alias("theta"))
    blocks = stage(entries.groupBy(*BLOCK).applyInPandas(_summary, "dims int, prefix long, sub int, centre array<double>, radius double"), "blocks")
    q_groups, b_groups = max(1, -(-asked.count() // query_block)), max(1, -(-blocks.count() // SUMMARY_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = asked.join(kth, query, "left").withColumn("theta", F.coalesce("theta", F.lit(-1.0))).withColumn("qg", F.pmod(F.xxhash64("query_id"), F.lit(q_groups)).cast("int")).withColumn("bg", each(b_groups))
    shown = blocks.withColumn("bg", F.pmod(F.xxhash64("prefix", "sub"), F.lit(b_groups)).cast("int")).withColumn("qg", each(q_groups))
    pairs = stage(asking.groupBy("dims", "qg", "bg").cogroup(shown.groupBy("dims", "qg", "bg")).applyInPandas(_route, "query_id long, query_key string, embedding array<double>, theta double, dims int, prefix long, sub int"), "pairs")
    return ranked(first.drop("rank").unionByName(meet(pairs))).select("query_id", "rank", "vec_id", "score")


def op3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def exact_neighbours(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int = K) -> dict[int, list[tuple[int, float]]]:
    """Brute force over sound vectors, for measuring recall."""
    length = np.sqrt((x * x).sum(axis=1))
    out = {}
    for j in queries.tolist():
        score = (x * x[j]).sum(axis=1) / (length * length[j])
        best = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != ids[j])
        out[int(ids[j])] = [(i, -s) for s, i in best[:k]]
    return out
