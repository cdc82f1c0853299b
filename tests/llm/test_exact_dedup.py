from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from glyphweave.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, digest string, run int, copies string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def plain(rows, pick):
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {(i, pick(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


def test_groups_against_a_plain_version(spark):
    rows = [(k, f"text {k % 37}" * (k % 5)) for k in range(500)] + [(1000 + k, None) for k in range(300)]
    for keep, pick in (("largest", max), ("smallest", min)):
        for leaves, fan_in in ((256, 16), (8, 2), (1, 2)):
            got = exact_dedup(table(spark, rows).repartition(9), keep=keep, leaves=leaves, fan_in=fan_in).collect()
            assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == plain(rows, pick)
            assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_one_row_of_a_group_stays_with_ties_and_null_ids(spark):
    rows = [(7, "a"), (7, "a"), (None, "a"), (None, "b"), (None, "b"), (3, ""), (4, None)]
    got = exact_dedup(table(spark, rows), keep="largest").collect()
    assert len(got) == 7
    kept = {}
    for r in got:
        kept.setdefault(r.text_sha256, []).append(r.kept)
    assert all(sum(k) == 1 for k in kept.values()) and len(kept) == 3
    assert {r.keep_id for r in got} == {7, None, 4}


def test_empty_table_and_very_long_text(spark):
    assert exact_dedup(table(spark, [])).count() == 0
    long = "word " * 400_000
    got = exact_dedup(table(spark, [(1, long), (2, long), (3, long + "x")])).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True, False, True]


def test_a_hot_text_is_spread_and_whole(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup(rows, keep="largest")
    hot = got.filter("group_size > 1").agg(F.count(F.lit(1)).alias("n"), F.max("keep_id").alias("k"), F.sum(F.col("kept").cast("int")).alias("s")).first()
    assert got.count() == 6000 and (hot.n, hot.k, hot.s) == (2000, 5997, 1)


def test_row_column_is_carried(spark):
    rows = table(spark, [(1, "a"), (1, "a"), (2, "b")]).withColumn("row", F.monotonically_increasing_id())
    got = exact_dedup(rows, row_col="row").collect()
    assert len({r.row for r in got}) == 3 and sum(r.kept for r in got) == 2
