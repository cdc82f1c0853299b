"""A corpus pipeline: language, exact copies, near copies, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
to the shared folder and reads it again as the next stage's documents. All but the last stage return
the columns of the documents they got, and work on them whatever else those columns are called.

Every stage handles each row as a document of its own: ids may be null or repeated, a null text counts
as empty, and an empty table gives an empty table. What a stage stages lies under spark.checkpoint.dir
until the next stage of the same thread over the same tables begins: write a stage's result before then.
"""

from __future__ import annotations

from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweave.llm.common import noting, release, stage
from glyphweave.llm.exact_dedup import exact_dedup
from glyphweave.llm.language import keep_told, learn
from glyphweave.llm.packing import pack
from glyphweave.llm.pii import find_private
from glyphweave.llm.simhash import near_dedup
from glyphweave.ship import ship

#: By folder of tables, what the stage before has staged; of this thread, so that pipelines beside one another keep theirs.
_staged: ContextVar[dict[str, list[str]] | None] = ContextVar("staged", default=None)


def _tidy(step):
    """A stage that first removes what the stage before has staged."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        by_folder = _staged.get() or {}
        folders = by_folder.setdefault(sf_dir, [])
        _staged.set(by_folder)
        release(spark, folders)
        with noting(folders):
            return step(spark, docs, sf_dir)

    return run_step


def _unused(docs: DataFrame, name: str) -> str:
    """A name that no column of the documents has, in any case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The documents with a number of their own, fixed by writing them down, so that null and repeated ids can't mix rows; and its column."""
    row = _unused(docs, "_row")
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), name), row


@_tidy
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; what the classifier rejects goes: texts that are null or without letters, and narrow margins."""
    return keep_told(docs, learn(docs))


@_tidy
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id (null ids lose; of repeated rows the first read stays). Null and empty texts are one group."""
    rows, row = _numbered(docs, "exact")
    dropped = exact_dedup(rows, keep="largest", row_col=row).filter("NOT kept").select(row)
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


@_tidy
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id (null ids last, then as read). Texts without words are one group."""
    rows, row = _numbered(docs, "near")
    classes = stage(near_dedup(rows, id_col=row).select(F.col("doc_id").alias(row), F.col("component_id").alias("class")), "near-classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row)).alias("first")
    kept = classes.join(rows.select(row, "doc_id"), row).groupBy("class").agg(first).select(F.col(f"first.{row}").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


@_tidy
def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data, and of secrets, is replaced by the name of its kind in brackets; every document stays."""
    rows, row = _numbered(docs, "private")
    held = _unused(docs, "_spans")
    spans = find_private(rows, id_col=row).filter("spans <> ''").select(F.col("doc_id").alias(row), F.col("spans").alias(held))
    both = rows.join(spans, row, "left")
    return both.withColumn("text", F.when(F.col(held).isNull(), F.col("text")).otherwise(_redacted(held))).select(*docs.columns)


def _redacted(spans: str) -> Column:
    """Spans by place; one that begins within an earlier one is covered by it. SQL functions only."""
    parsed = f"array_sort(transform(split(`{spans}`, ','), x -> named_struct('s', cast(split(x, ':')[1] as bigint), 'e', cast(split(x, ':')[2] as bigint), 'k', split(x, ':')[0])))"
    step = """named_struct('at', greatest(a.at, x.e), 'out', CASE WHEN x.s < a.at THEN a.out
        ELSE concat(a.out, array(substring(text, cast(a.at + 1 as int), cast(x.s - a.at as int)), concat('[', x.k, ']'))) END)"""
    folded = f"aggregate({parsed}, named_struct('at', 0L, 'out', cast(array() as array<string>)), (a, x) -> {step}, a -> concat(a.out, array(substring(text, cast(a.at + 1 as int)))))"
    return F.array_join(F.expr(folded), "")


@_tidy
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left; a document without text is one closing token."""
    return pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("private", private), ("packing", packing)]

#: Compression, fingerprints and tokenizers can't be told in SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. The results of the stages before it are removed; the last lies under spark.checkpoint.dir for the caller to read."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list[str] = []
    for name, step in STAGES:
        before, last = last, []
        made = step(spark, docs, sf_dir)
        with noting(last):
            docs = stage(made, f"pipeline-{name}")
        release(spark, before)
    release(spark, (_staged.get() or {}).pop(sf_dir, []))
    return docs
