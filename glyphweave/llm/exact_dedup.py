"""Exact dedup by a tree-merge of sorted digest runs.

Every scan partition makes one sorted run of text digests. Runs are merged in rounds of a binomial
tree, FAN_IN at a time (log2(FAN_IN) binomial steps at once). The digest space is cut into BUCKETS
ranges that each have a tree of their own, so even the root round is spread over the cluster. Each
merge keeps, for every digest, the identifier that wins and the number of rows below it; a text that
holds a third of all rows thus leaves one row a run after the first round.

A digest is verified: two texts are equal when SHA-256, byte length and an independent XXH64 agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, stage, table, text_of

LEAVES = 256
FAN_IN = 16
BUCKETS = 4096

RUN_SCHEMA = "bucket int, run int, digest binary, n_bytes long, mark long, best long, best_seq long, copies long"
ARROW_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("run", pa.int32()), ("digest", pa.binary()), *[(n, pa.int64()) for n in ("n_bytes", "mark", "best", "best_seq", "copies")]]
)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse neighbours with one digest. Rows come sorted by bucket, run, digest and then winner first.

    One row is carried from batch to batch, so memory is bounded by a batch whatever a group's size.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).cast(ARROW_SCHEMA)
        if held is not None:
            rows = pa.concat_tables([held, rows])
        n = rows.num_rows
        digest = rows["digest"].combine_chunks()
        keys = np.frombuffer(b"".join(digest.to_pylist()), dtype=np.uint8).reshape(n, -1)
        new = np.ones(n, dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        for name in ("bucket", "run", "n_bytes", "mark"):
            v = rows[name].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        first = np.flatnonzero(new)
        copies = np.add.reduceat(rows["copies"].to_numpy(), first)
        merged = rows.take(pa.array(first)).set_column(rows.schema.get_field_index("copies"), "copies", pa.array(copies, pa.int64()))
        if len(first) > 1:
            yield from merged.slice(0, len(first) - 1).combine_chunks().to_batches()
        held = merged.slice(len(first) - 1)
    if held is not None:
        yield from held.combine_chunks().to_batches()


def _round(runs: DataFrame, largest: bool) -> DataFrame:
    winner = F.col("best").desc_nulls_last() if largest else F.col("best").asc_nulls_last()
    return runs.sortWithinPartitions("bucket", "run", "digest", "n_bytes", "mark", winner, "best_seq").mapInArrow(_merge, RUN_SCHEMA)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", leaves: int = LEAVES, fan_in: int = FAN_IN, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and row_col if it is named.

    keep is "smallest" or "largest": which identifier of a group of equal texts stays. Null text
    counts as empty. A null id loses to any other. Of several rows with the id that stays, the first
    (by row_col, a column of distinct longs, or else as read) is kept and the others are dropped, so
    one row of a group is kept, always. An empty table gives no rows. Columns besides those named are
    ignored, whatever they are called.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    text = text_of(text_col)
    rows = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.xxhash64(text).alias("mark"),
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("seq"),
            F.spark_partition_id().alias("leaf"),
        ),
        "digests",
    )
    bucket = F.pmod(F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int"), F.lit(BUCKETS))
    runs = rows.select(
        bucket.cast("int").alias("bucket"),
        F.pmod("leaf", F.lit(leaves)).cast("int").alias("run"),
        "digest",
        "n_bytes",
        "mark",
        F.col("doc_id").alias("best"),
        F.col("seq").alias("best_seq"),
        F.lit(1).cast("long").alias("copies"),
    )
    largest = keep == "largest"
    runs = _round(runs, largest)  # the sorted runs of the leaves: no exchange
    width = leaves
    while True:
        width = -(-width // fan_in)
        runs = runs.withColumn("run", F.expr(f"run div {fan_in}").cast("int")).repartition("bucket", "run")
        runs = _round(runs, largest)
        if width == 1:
            break
    winners = stage(runs.select("digest", "n_bytes", "mark", "best", "best_seq", "copies"), "winners")
    out = salted_join(rows, winners, ["digest", "n_bytes", "mark"], "copies", rows.count(), F.col("seq"))
    return out.select(
        "doc_id",
        F.col("best").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("seq") == F.col("best_seq")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *([F.col("seq").alias(row_col)] if row_col else []),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
