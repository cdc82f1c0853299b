"""Harmonic packing of tokenised documents into sequences.

Lengths fall into reciprocal-capacity classes: class k takes lengths of which k fit into one sequence,
and every bin of class k holds exactly k pieces. A document gives as many full sequences as it can;
its rest is cut at the largest reciprocal of the capacity that fits, again and again, so that a bin
of k pieces is full or nearly so. Each worker fills bins of every class on its own, without a shuffle.
What is left over, fewer than k pieces a class and worker, goes up a tree of workers, TREE at a time,
and is binned again by class; the root, which sees fewer than sum(k - 1) pieces whatever the input,
packs the last of them first-fit decreasing.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, stage, table

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 1024
#: A rest that leaves a bin of its class at most this many tokens short stays whole.
SLACK = 4
TREE = 64
#: tiktoken's pattern overflows its stack on white space of a million characters, so runs far below that go to the tokenizers library.
BLANK = 50_000
VOCABULARY = "byte_bpe_50k.json"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, worker long"


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """Text to ids by a byte-level BPE file of the tokenizers library (special tokens' strings are ordinary text).

    The file's own vocabulary is run by tiktoken, whose ids are the same and which is over four times
    as fast; tests hold the two against each other.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"] for x in model.get("added_tokens", [])}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    ranks = {bytes(to_byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def library(vocabulary: str) -> Tokenizer:
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


@lru_cache(maxsize=2)
def added_tokens(vocabulary: str) -> dict[str, int]:
    """Contents and ids of the added tokens of a vocabulary; such as take in what is beside them aren't known here."""
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(x[flag] for x in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{vocabulary} has added tokens that aren't matched by their content alone")
    return {x["content"]: x["id"] for x in added}


def has_long_blank(text: str) -> bool:
    """Whether one of the text's windows of BLANK characters is white space only: so it is with any run of 2 * BLANK - 1 or more."""
    return any(text[at : at + BLANK].isspace() for at in range(0, len(text) - BLANK + 1, BLANK))


def tokeniser(vocabulary: str) -> Callable[[str], list[int]]:
    """Text of any length to the ids of the tokenizers library, added tokens as one id each.

    What is between added tokens goes through encoder(), and through the library itself where encoder() can't read on.
    """
    encode = encoder(vocabulary)
    added = added_tokens(vocabulary)
    parts = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None

    def plain(text: str) -> list[int]:
        if has_long_blank(text):
            return library(vocabulary).encode(text, add_special_tokens=False).ids
        return encode(text)

    def run(text: str) -> list[int]:
        if parts is None or not any(x in text for x in added):
            return plain(text)
        out: list[int] = []
        for k, part in enumerate(parts.split(text)):
            if k % 2:
                out.append(added[part])
            elif part:
                out += plain(part)
        return out

    return run


def cuts(length: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int]]:
    """Pieces (length, class) of a document of that many tokens, in order."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack:
            out.append((rest, k))
            break
        k = -(-capacity // rest)
        out.append((capacity // k, k))
        rest -= capacity // k
    return out


def _fill(capacity: int, slack: int, vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The workers' pass: tokenise, cut, and fill bins of every class; pieces of unfilled bins come last, without a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokeniser(vocabulary)
        worker = TaskContext.get().partitionId()
        next_id = worker << 28
        open_bins: dict[int, list[tuple]] = {}

        for batch in few(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), 0], dtype="<u4")
                start = 0
                for length, k in cuts(len(ids), capacity, slack):
                    piece = (doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids))
                    start += length
                    held = open_bins.setdefault(k, [])
                    held.append(piece)
                    if len(held) == k:
                        rows += _bin(held, next_id, worker)
                        next_id += 1
                        open_bins[k] = []
            yield _batch(rows)
        yield _batch([(*p, None, None, worker) for k in sorted(open_bins) for p in open_bins[k]])

    return run


def _bin(pieces: list[tuple], sequence: int, worker: int) -> list[tuple]:
    out, at = [], 0
    for p in pieces:
        out.append((*p, sequence, at, worker))
        at += p[2]
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def _merge(level: int, root: bool, capacity: int, tree: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A node of the tree: bins of k from what its workers left; at the root, first-fit decreasing for the last."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["worker", "doc_id", "start", "ids_crc32"], na_position="first", kind="stable")
        group = int(rows["worker"].iloc[0]) // tree
        next_id = (level << 59) | (group << 28)
        left: dict[int, list[tuple]] = {}
        out: list[tuple] = []
        for doc_id, start, length, crc, tokens in rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False):
            k = capacity // length
            held = left.setdefault(k, [])
            held.append((None if pd.isna(doc_id) else int(doc_id), int(start), int(length), int(crc), int(tokens)))
            if len(held) == k:
                out += _bin(held, next_id, group)
                next_id += 1
                left[k] = []
        last = [p for k in sorted(left) for p in left[k]]
        if not root:
            out += [(*p, None, None, group) for p in last]
        else:
            bins: list[list[tuple]] = []
            room: list[int] = []
            for p in sorted(last, key=lambda p: -p[2]):
                at = next((i for i, r in enumerate(room) if r >= p[2]), None)
                if at is None:
                    bins.append([p])
                    room.append(capacity - p[2])
                else:
                    bins[at].append(p)
                    room[at] -= p[2]
            for b in bins:
                out += _bin(b, next_id, group)
                next_id += 1
        names = [x.split()[0] for x in PIECES.split(", ")]
        # Columns one by one: a null among large numbers would make floats of a whole frame.
        return pd.DataFrame({n: pd.array([r[k] for r in out], dtype="Int64") for k, n in enumerate(names)})

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, slack: int = SLACK, vocabulary: str = VOCABULARY, tree: int = TREE) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row is a document of its own, repeated rows and null ids too; null text is empty and gives
    the one closing token. A document of any length is tokenised whole. An empty table gives no rows.
    sequence_id is unique, not dense: level, worker and bin are its upper 4, middle 31 and lower 28 bits. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    filled = stage(rows.mapInArrow(_fill(capacity, slack, vocabulary), PIECES), "pieces")
    done = filled.filter("sequence_id IS NOT NULL")
    left = filled.filter("sequence_id IS NULL")
    workers = (left.agg(F.max("worker")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        workers = -(-workers // tree)
        merged = stage(left.groupBy(F.expr(f"worker div {tree}")).applyInPandas(_merge(level, workers == 1, capacity, tree), PIECES), "pieces")
        done = done.union(merged.filter("sequence_id IS NOT NULL"))
        if workers == 1:
            break
        left = merged.filter("sequence_id IS NULL")
    return done.drop("worker")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
