"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of 2 bits; its embedding is the vector of their bit
counts, and the Manhattan distance of two embeddings is never more than the Hamming distance of the
fingerprints. Counts are kept in unary (0, 01, 11), so that a Manhattan distance is the bit count of
an exclusive or. If two embeddings are within 3, then within 1 in the first or in the second half:
the grid has a cell for every value of a half, each fingerprint is put into its own cell of both
halves and probes the cells one step up, and a range-join of the two finds every pair. Candidates
must pass the Manhattan bound over all segments and then the exact Hamming distance.

Distinct fingerprints are linked, not documents: a group of copies is one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, salted_join, stage, table
from .components import components
from .fingerprint import fingerprints

DISTANCE = 3
LOW = 0x5555555555555555
HALF = 16


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few(batches):
        prints = fingerprints(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a signed long, for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _embedding(fp: str) -> str:
    """Unary bit counts of the 2-bit segments: the low bit says one or more, the high bit says two."""
    return f"((({fp} | shiftrightunsigned({fp}, 1)) & {LOW}L) | (({fp} & shiftleft({fp}, 1)) & ~{LOW}L))"


def _cells(probes: bool) -> str:
    """Keys of the grid cells of column u: its own of both halves, and with probes those one step up."""
    out = []
    for half in (0, 1):
        cell = f"(shiftrightunsigned(u, {32 * half}) & 4294967295L)"
        tag = half << 32
        out.append(f"named_struct('cell', {cell} | {tag}L, 'step', 0)")
        for i in range(HALF if probes else 0):
            low, high = 1 << 2 * i, 2 << 2 * i
            up = f"CASE WHEN {cell} & {low}L = 0 THEN {cell} | {low}L WHEN {cell} & {high}L = 0 THEN {cell} | {high}L END"
            out.append(f"named_struct('cell', ({up}) | {tag}L, 'step', 1)")
    return f"array({', '.join(out)})"


def links(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of the distinct fingerprints of column fp at DISTANCE or fewer differing bits (a pair may come twice)."""
    embedded = nodes.select("fp", F.expr(_embedding("fp")).alias("u"))
    probe = embedded.select("fp", "u", F.explode(F.expr(_cells(True))).alias("c")).filter("c.cell IS NOT NULL").select(F.col("fp").alias("a"), F.col("u").alias("ua"), "c.cell", "c.step")
    home = embedded.select("fp", "u", F.explode(F.expr(_cells(False))).alias("c")).select(F.col("fp").alias("b"), F.col("u").alias("ub"), "c.cell")
    near = (
        (probe["cell"] == home["cell"])
        & ((F.col("step") == 1) | (F.col("a") < F.col("b")))
        & (F.bit_count(F.col("ua").bitwiseXOR(F.col("ub"))) <= DISTANCE)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    )
    return probe.join(home, near).select("a", "b")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links (null ids don't count; a component of null
    ids alone has a null one). Null and empty texts, and texts without words, have fingerprint zero
    and are linked like any other. Repeated rows are copies. Other columns are ignored.
    """
    prints = stage(fingerprint_table(docs, id_col, text_col), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    roots = components(links(nodes)).withColumnRenamed("node", "fp")
    joined = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    classes = stage(salted_join(joined, smallest, ["root"], "members", nodes.count(), F.col("fp")).select("fp", "component_id", "copies"), "classes")
    out = salted_join(prints, classes, ["fp"], "copies", prints.count(), F.xxhash64("doc_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
