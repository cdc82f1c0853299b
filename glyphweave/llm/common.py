"""Shared pieces of the training-data operators: inputs, staged tables, skew-proof joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in HOT_SHARE rows; its rows are spread over SALTS tasks.
HOT_SHARE = 1000
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="glyphweave-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Where the folders of staged tables are noted, if somebody sees to their removal.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back: lineage ends there and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glyphweave/{name}-{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noting(folders: list[str]) -> Iterator[None]:
    """Note the folders of all tables staged within in `folders`."""
    token = _noted.set(folders)
    try:
        yield
    finally:
        _noted.reset(token)


def release(spark: SparkSession, folders: list[str]) -> None:
    """Remove staged tables that no result still to be read depends on."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while folders:
        path = jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Rows of a batch that a Python worker takes in hand at once.
FEW = 256


def few(batches: Iterator[pa.RecordBatch], rows: int = FEW) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what Python makes of a batch is small, however many rows Spark sends together."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], size: str, total: int, spread: Column, how: str = "inner") -> DataFrame:
    """Join many rows to one or a few rows a key, where `one` carries in `size` how many rows of `many` have the key.

    A key of over total/HOT_SHARE rows is salted: at most HOT_SHARE keys can be so large, so at most
    HOT_SHARE * SALTS rows of `one` are added, whatever the input. `spread` deals the rows of a key evenly.
    Both sides learn hotness from a broadcast list of those at most HOT_SHARE keys.
    """
    limit = max(total // HOT_SHARE, 1000)
    hot = one.filter(F.col(size) > limit).select(*[F.col(k).alias(f"_hot_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    left = (
        many.join(F.broadcast(hot), cond, "left")
        .withColumn("_salt", F.when(F.col(f"_hot_{keys[0]}").isNotNull(), F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
        .drop(*[f"_hot_{k}" for k in keys])
    )
    salts = F.when(F.col(size) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = one.withColumn("_salt", F.explode(salts))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
