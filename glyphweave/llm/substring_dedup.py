"""Removal of passages that occur more than once, by suffix arrays.

A byte goes if a string of SIZE bytes that covers it also starts anywhere else. Shorter repeats, covered
by strings of PASSAGE bytes that stand in another row, are told if they have over WORDS words, and stay.

1. Windows. Each start of PASSAGE bytes is keyed by the least hash of the GRAM-byte strings in it, so
   that equal windows have equal keys; a run of starts with one key is a region. A key whose string
   stands once in all texts has no equal windows and is left behind, before any text moves.
2. Regions. Those whose keys repeat are told by digest in one copy of each text, and equal ones are
   counted. A key all of whose regions stand in several rows as they are is settled. The bytes of one
   copy of the other regions are cut and dealt by key: windows of one content always meet. A shard
   takes whole keys up to SHARD_BYTES; a key with over KEY_REGIONS regions has several sub-shards.
3. Suffix arrays. Each shard sorts its suffixes by Larsson-Sadakane refinement, gets common prefixes
   after Kasai, and so the classes of equal windows of both sizes. Up to PAIRED sub-shards of a key are
   merged by looking up the windows of one in the suffix array of the other by binary search. More of
   them would make too many pairs: each tells sorted runs of the 128-bit digests of its classes, and the
   runs of one part of all digests are merged, so that the work of a key grows as its regions do.
4. Windows held twice or more, weighted by copies, go back to all texts with their region.

A text that appears in many rows is handled once, with its count. A hot key or region never meets one
task: counts are combined before shuffles and joins are salted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, salted_join, stage, table, text_of
from .suffix import common_prefixes, found_in, suffix_array, words8

if TYPE_CHECKING:
    import pandas as pd

SIZE = 400
#: Shorter strings, of which runs of more than WORDS words are told as passages. 51 words of prose take more bytes.
PASSAGE = 256
WORDS = 50
GRAM = 64
SHARD_BYTES = 500_000
KEY_REGIONS = 500
#: Sub-shards of a key that are merged pair by pair; those of a larger key exchange the digests of their classes.
PAIRED = 4
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, CHUNK + 1), _powers(_INVERSE, CHUNK + 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each position, the same wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * _DOWN[: n - gram + 1]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by running minima from both ends of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.uint64(2**64 - 1), dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def regions(data: np.ndarray, size: int = PASSAGE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first start, end of starts, key, uses: the runs of window starts with one key (a run also ends with a chunk).

    uses is 2 where the key's string stands more than once in the run, so that windows within it may be equal, else 1.
    """
    width = size - gram + 1
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(data) - size + 1, CHUNK - size):
        part = data[lo : lo + CHUNK - 1]
        if len(part) < size:
            break
        grams = gram_hashes(part, gram)
        key = sliding_least(grams, width)[: CHUNK - size]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        comes = grams[width - 1 : width - 1 + len(key)] == key  # the string stands at a window's end
        comes[first] = False
        many = np.logical_or.reduceat(comes, first)
        for at in range(0, len(first), 4096):
            f = first[at : at + 4096]
            many[at : at + 4096] |= np.count_nonzero(grams[f[:, None] + np.arange(width)] == key[f][:, None], axis=1) > 1
        out.append((lo + first, lo + np.append(first[1:], len(key)), key[first].view(np.int64), 1 + many.astype(np.int64)))
    if not out:
        return (np.empty(0, dtype=np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _key_windows(size: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            made = [regions(np.frombuffer(_bytes(t), dtype=np.uint8), size, gram) for t in batch.column(2).to_pylist()]
            count = [len(x[0]) for x in made]
            starts, ends, keys, uses = (np.concatenate(x) if made else np.empty(0, np.int64) for x in zip(*made, strict=True)) if made else (np.empty(0, np.int64),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (np.repeat(t1, count), np.repeat(t2, count), starts, ends, keys, uses)], ["t1", "t2", "s", "e", "key", "uses"])

    return run


#: A region of a text: its digest (of its bytes and its number of window starts), and how many rows hold its text.
PLACE = "key long, d1 long, d2 long, t1 long, t2 long, s long, starts long, length long, copies long, lo long, hi long"


def _digests(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The regions of held texts by digest. lo and hi differ if more than one row holds the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PLACE.split(", ")]
        table_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
        for batch in few(batches):
            rows: list[tuple] = []
            for t1, t2, text, found, copies in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                data = _bytes(text)
                other = t1 ^ 1 if copies > 1 else t1
                for r in found:
                    piece, starts = data[r["s"] : r["e"] + size - 1], r["e"] - r["s"]
                    d = xxhash.xxh3_128_digest(piece, starts)
                    rows.append((r["key"], int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), t1, t2, r["s"], starts, len(piece), copies, min(t1, other), max(t1, other)))
                    if len(rows) >= 8_000:
                        yield table_of(rows)
                        rows = []
            if rows:
                yield table_of(rows)

    return run


PIECE = "key long, d1 long, d2 long, starts long, copies long, lo long, hi long, sub int, m int, i int, j int, data binary"


def _cut(size: int, paired: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of the regions that are to be sorted, one row for each pair of sub-shards that a region takes part in."""

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 7 + [pa.int32()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        weight = 0
        for batch in few(batches):
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = _bytes(text)
                for r in wanted:
                    piece = data[r["s"] : r["s"] + r["length"]]
                    own, m = r["sub"], r["m"]
                    for other in range(m) if m <= paired else (own,):
                        rows.append((r["key"], r["d1"], r["d2"], r["starts"], r["copies"], r["lo"], r["hi"], own, m, min(own, other), max(own, other), piece))
                        weight += len(piece)
                    if weight > 8_000_000:
                        yield table_of(rows)
                        rows, weight = [], 0
        if rows:
            yield table_of(rows)

    return run


class Shard:
    """Regions of whole keys, with their suffix array and what neighbours in it share."""

    def __init__(self, rows: list[dict], passage: int):
        pieces = [r["data"] for r in rows]
        self.data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.length = np.array([len(x) for x in pieces], dtype=np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.runs = np.array([r["starts"] for r in rows], dtype=np.int64)
        self.copies, self.lo, self.hi = (np.array([r[k] for r in rows], dtype=np.int64) for k in ("copies", "lo", "hi"))
        owner = np.repeat(np.arange(len(pieces)), self.length)
        offset = np.arange(len(self.data)) - self.begin[owner]
        first = words8(self.data)
        sa = suffix_array(self.data, first)
        shared = common_prefixes(self.data, sa, first)
        window = offset[sa] < self.runs[owner[sa]]
        self.starts, self.owner = sa[window], owner[sa[window]]
        self.room = self.length[self.owner] - offset[self.starts]
        self.new = {}
        self._shared, self._window = shared, window

    def level(self, size: int) -> Level:
        """The classes of equal windows of `size` bytes: suffixes that aren't starts of one are left out; what their neighbours share is the least on the way."""
        return Level(self, np.cumsum(self._shared < size)[self._window], self.room >= size, size)

    def spans(self, starts: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each region the runs of the given window starts."""
        flag = np.zeros(len(self.data) + 2, dtype=np.int8)
        flag[starts + 1] = 1
        edge = np.diff(flag)
        out: list[list[tuple[int, int]]] = [[] for _ in self.begin]
        up, down = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        # Starts of one region never touch those of the next: a region ends with the rest of its last window.
        at = np.searchsorted(self.begin, up, "right") - 1
        for k, a, b in zip(at.tolist(), (up - self.begin[at]).tolist(), (down - self.begin[at]).tolist(), strict=True):
            out[k].append((a, b))
        return out


class Level:
    """Equal windows of one size within a shard, by class, in suffix order."""

    def __init__(self, shard: Shard, group: np.ndarray, valid: np.ndarray, size: int):
        self.shard, self.size = shard, size
        self.starts, owner, group = shard.starts[valid], shard.owner[valid], group[valid]
        self.head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, np.int64)
        self.classes = np.repeat(np.arange(len(self.head)), np.diff(np.append(self.head, len(group))))
        some = len(self.head) > 0
        self.weight, self.lo, self.hi = (f.reduceat(x[owner], self.head) if some else x[:0] for f, x in ((np.add, shard.copies), (np.minimum, shard.lo), (np.maximum, shard.hi)))
        self.owner = owner

    def repeated(self, across: bool) -> np.ndarray:
        """Classes held twice or more; `across`: by more than one row."""
        return self.lo != self.hi if across else self.weight > 1

    def spans(self, classes: np.ndarray) -> list[list[tuple[int, int]]]:
        return self.shard.spans(self.starts[classes[self.classes]] if len(self.classes) else self.starts)


def merge_levels(a: Level, b: Level, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which classes of a are in b, and which of b in a: a string a class of a is looked up in b's suffix array by binary search."""
    hit_a, hit_b = np.zeros(len(a.head), dtype=bool), np.zeros(len(b.head), dtype=bool)
    span = np.arange(a.size)
    for lo in range(0, len(a.head), 1 << 13):
        needles = a.shard.data[a.starts[a.head[lo : lo + (1 << 13)]][:, None] + span]
        hit, place = found_in(needles, b.shard.data, b.starts, a.size)
        ka, kb = lo + np.flatnonzero(hit), b.classes[place[hit]] if len(b.classes) else np.empty(0, np.int64)
        if across:
            cross = np.minimum(a.lo[ka], b.lo[kb]) != np.maximum(a.hi[ka], b.hi[kb])
            ka, kb = ka[cross], kb[cross]
        hit_a[ka], hit_b[kb] = True, True
    return hit_a, hit_b


#: A run of repeated windows, or (part and run) the digests of a shard's classes in one part of all digests.
FOUND = "key long, d1 long, d2 long, a long, b long, across boolean, part int, run binary"
#: What a run holds of each class: digest, rows that hold it, whether it is settled, and if not its region and place.
RUN = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("lo", "<i8"), ("hi", "<i8"), ("done", "<i8"), ("d1", "<i8"), ("d2", "<i8"), ("a", "<i8")])


def _sort_shards(size: int, passage: int, shard_bytes: int, paired: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by key and pair of sub-shards. Small keys share a suffix array; a pair of sub-shards is merged."""
    levels = ((size, False), (passage, True))

    def of(rows: list[dict], spans: list[list[tuple[int, int]]], across: bool) -> list[tuple]:
        return [(r["key"], r["d1"], r["d2"], a, b, across, None, None) for r, found in zip(rows, spans, strict=True) for a, b in found]

    def solve(rows: list[dict], tell: bool = False) -> list[tuple]:
        """The repeated windows of a shard; `tell`: and a digest of each class, for shards that hold other regions of the key."""
        shard, out = Shard(rows, passage), []
        for z, across in levels:
            level = shard.level(z)
            repeated = level.repeated(across)
            out += of(rows, level.spans(repeated), across)
            if tell and len(level.head):
                out += [(rows[0]["key"], None, None, None, None, across, part, run) for part, run in runs_of(shard, level, rows, repeated)]
        return out

    def runs_of(shard: Shard, level: Level, rows: list[dict], repeated: np.ndarray) -> Iterator[tuple[int, bytes]]:
        shown = ~repeated[level.classes]
        shown[level.head] = True
        at = np.flatnonzero(shown)
        place, owner, of_class, data = level.starts[at], level.owner[at], level.classes[at], shard.data.tobytes()
        run = np.empty(len(at), dtype=RUN)
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[p : p + level.size]) for p in place.tolist()), dtype="<u8").reshape(-1, 2)
        run["h1"], run["h2"] = digests[:, 0], digests[:, 1]
        run["lo"], run["hi"], run["done"] = level.lo[of_class], level.hi[of_class], repeated[of_class]
        for k in ("d1", "d2"):
            run[k] = np.array([r[k] for r in rows], dtype=np.int64)[owner]
        run["a"] = place - shard.begin[owner]
        run.sort(order=["h1", "h2"])
        part = part_of(run["h1"], rows[0]["m"])
        for x in np.unique(part).tolist():
            lo, hi = np.searchsorted(part, [x, x + 1])
            yield x, run[lo:hi].tobytes()

    def cross(rows: list[dict]) -> list[tuple]:
        sides = [[r for r in rows if r["sub"] == rows[0]["i"]], [r for r in rows if r["sub"] == rows[0]["j"]]]
        if not all(sides):
            return []
        one, two = (Shard(x, passage) for x in sides)
        out = []
        for z, across in levels:
            a, b = one.level(z), two.level(z)
            for rows_of, level, hit in zip(sides, (a, b), merge_levels(a, b, across), strict=True):
                out += of(rows_of, level.spans(hit), across)
        return out

    def table_of(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) if found else [[]] * 8
        kinds = [*[pa.int64()] * 5, pa.bool_(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: list[dict] = []
        small_bytes = 0
        group: list[dict] = []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal small, small_bytes
            if group and group[0]["i"] != group[0]["j"]:
                yield table_of(cross(group))
            elif group and group[0]["m"] > paired:
                yield table_of(solve(group, True))
            else:
                small += group
                small_bytes += sum(len(r["data"]) for r in group)
                if small_bytes >= shard_bytes:
                    yield table_of(solve(small))
                    small, small_bytes = [], 0

        for batch in few(batches):
            for r in batch.to_pylist():
                if group and (r["key"], r["i"], r["j"]) != (group[0]["key"], group[0]["i"], group[0]["j"]):
                    yield from done()
                    group = []
                group.append(r)
        yield from done()
        if small:
            yield table_of(solve(small))

    return run


def part_of(h1: np.ndarray, parts: int) -> np.ndarray:
    """The part of all digests, of `parts` equal ones, in which each lies."""
    return ((h1 >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


MERGED = "key long, d1 long, d2 long, a long, b long, across boolean"


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, level and part: the runs that a key's shards tell of one part of the digests are merged."""

    def merged(key: int, across: bool, runs: list[bytes]) -> Iterator[pa.RecordBatch]:
        all_of = np.frombuffer(b"".join(runs), dtype=RUN)
        all_of = all_of[np.lexsort((all_of["h2"], all_of["h1"]))]
        head = np.flatnonzero(np.concatenate(([True], (all_of["h1"][1:] != all_of["h1"][:-1]) | (all_of["h2"][1:] != all_of["h2"][:-1]))))
        size = np.diff(np.append(head, len(all_of)))
        again = np.minimum.reduceat(all_of["lo"], head) != np.maximum.reduceat(all_of["hi"], head) if across else size > 1
        hit = all_of[np.repeat(again, size) & (all_of["done"] == 0)]
        if len(hit):
            cols = [np.full(len(hit), key), hit["d1"], hit["d2"], hit["a"], hit["a"] + 1]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c), pa.int64()) for c in cols), pa.array(np.full(len(hit), across))], [x.split()[0] for x in MERGED.split(", ")])

    at: tuple | None = None
    runs: list[bytes] = []
    for batch in few(batches):
        for key, across, part, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at is not None and at != (key, across, part):
                yield from merged(at[0], at[1], runs)
                runs = []
            at = (key, across, part)
            runs.append(run)
    if at is not None:
        yield from merged(at[0], at[1], runs)


_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def _remove(size: int, passage: int, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in few(batches):
            out = []
            for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = _bytes(text)
                spans = covered([(r["a"], r["b"]) for r in runs if not r["across"]], size)
                h, at = hashlib.sha256(), 0
                for a, b in spans:
                    h.update(data[at:a])
                    at = b
                h.update(data[at:])
                again = [(a, b) for a, b in covered([(r["a"], r["b"]) for r in runs if r["across"]], passage) if len(_WORDS.findall(data, a, b)) > words]
                out.append((sum(b - a for a, b in spans), len(spans), h.digest(), [{"start": a, "end": b} for a, b in spans], [{"start": a, "end": b} for a, b in again]))
            removed, count, digest, spans, again = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(spans, span), pa.array(again, span)],
                ["t1", "t2", "n_removed", "n_spans", "kept", "spans", "passages"],
            )

    return run


def covered(runs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows that start in [a, b)."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + size - 1)
        else:
            out.append([a, b + size - 1])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, passage: int = PASSAGE, words: int = WORDS, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, key_regions: int = KEY_REGIONS, paired: int = PAIRED
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte runs removed), passages.

    passages are byte runs of more than `words` words that strings of `passage` bytes cover which also
    stand in another row; they are told, and removed only where strings of `size` bytes cover them.
    Null text counts as empty; texts below `size` bytes keep everything, even if they are equal.
    Strings within one text count, overlapping ones too, and a text in two rows is removed whole from
    both. Ids may be null or repeated. An empty table gives no rows. Other columns are ignored.
    """
    if not gram <= passage <= size:
        raise ValueError("gram <= passage <= size")
    text = text_of(text_col)
    digest = F.sha2(text, 256)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(digest).alias("t1"), F.xxhash64(digest, F.lit(1)).alias("t2"), text.alias("text"), digest.alias("digest"))
    ids = stage(rows.select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex("digest").alias("kept")), "ids")
    total = ids.count()
    found = stage(rows.select("t1", "t2", "text").mapInArrow(_key_windows(passage, gram), "t1 long, t2 long, s long, e long, key long, uses long"), "regions")
    again = found.groupBy("key").agg(F.sum("uses").alias("n")).filter("n > 1").select("key")
    by_text = found.join(again, "key", "left_semi").groupBy("t1", "t2").agg(F.collect_set(F.struct("s", "e", "key")).alias("found"))
    copies = ids.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"))
    # One copy of each text is moved, and of those that hold a repeated key one is staged.
    held = rows.groupBy("t1", "t2").agg(F.first("text").alias("text")).join(by_text.join(copies, ["t1", "t2"]).hint("shuffle_merge"), ["t1", "t2"])
    held = stage(held.select("t1", "t2", "text", "found", "copies"), "held")
    places = stage(held.select("t1", "t2", "text", "found", "copies").mapInArrow(_digests(size), PLACE), "places")
    distinct = stage(
        places.groupBy("key", "d1", "d2").agg(F.sum("copies").alias("copies"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("starts").alias("starts"), F.max("length").alias("length"), F.count(F.lit(1)).alias("uses"), F.min(F.struct("t1", "t2", "s")).alias("at")),
        "distinct",
    )
    # Where all regions of a key stand twice or more as they are, in more than one row, all their windows do and nothing is left to sort.
    settled = F.min((F.col("copies") > 1) & (F.col("lo") != F.col("hi")))
    parts = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n"), settled.alias("settled")).withColumn("m", F.ceil(F.col("n") / key_regions).cast("int"))
    sized = stage(salted_join(distinct, parts, ["key"], "n", distinct.count(), F.col("d1")), "sized")
    wanted = F.struct("key", "d1", "d2", "starts", "length", "copies", "lo", "hi", F.col("at.s").alias("s"), F.pmod("d1", F.col("m")).cast("int").alias("sub"), "m")
    wanted = sized.filter("NOT settled").groupBy("at.t1", "at.t2").agg(F.collect_list(wanted).alias("wanted"))
    cut = held.select("t1", "t2", "text").join(wanted.hint("shuffle_merge"), ["t1", "t2"]).select("text", "wanted").mapInArrow(_cut(size, paired), PIECE)
    dealt = cut.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    told = stage(dealt.mapInArrow(_sort_shards(size, passage, shard_bytes, paired), FOUND), "found")
    span = ["key", "d1", "d2", "a", "b", "across"]
    runs = told.filter("run IS NOT NULL").select("key", "across", "part", "run").repartition("key", "across", "part").sortWithinPartitions("key", "across", "part")
    merged = runs.mapInArrow(_merge_runs, MERGED).select(*span)
    easy = sized.filter("settled").select("key", "d1", "d2", F.explode(F.array(F.lit(False), F.lit(True))).alias("across"), F.lit(0).cast("long").alias("a"), "starts", "length")
    easy = easy.withColumn("b", F.when(F.col("across"), F.col("starts")).otherwise(F.least("starts", F.col("length") - size + 1))).filter("b > 0").select(*span)
    spans = told.filter("run IS NULL").select(*span).union(merged).union(easy)
    by_region = spans.groupBy("key", "d1", "d2").agg(F.collect_set(F.struct("a", "b", "across")).alias("spans")).join(distinct.select("key", "d1", "d2", "uses"), ["key", "d1", "d2"])
    back = salted_join(places.select("key", "d1", "d2", "t1", "t2", "s"), by_region, ["key", "d1", "d2"], "uses", places.count(), F.col("t1"))
    runs = back.select("t1", "t2", "s", F.explode("spans").alias("x")).select("t1", "t2", F.struct((F.col("s") + F.col("x.a")).alias("a"), (F.col("s") + F.col("x.b")).alias("b"), "x.across").alias("r"))
    of_text = held.select("t1", "t2", "text").join(runs.groupBy("t1", "t2").agg(F.collect_list("r").alias("runs")).hint("shuffle_merge"), ["t1", "t2"])
    schema = "t1 long, t2 long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>, passages array<struct<start: long, end: long>>"
    judged = stage(of_text.select("t1", "t2", "text", "runs").mapInArrow(_remove(size, passage, words), schema).withColumnRenamed("kept", "left").join(copies, ["t1", "t2"]), "judged")
    out = salted_join(ids, judged, ["t1", "t2"], "copies", total, F.xxhash64("doc_id"), "left")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return out.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.lower(F.hex(F.coalesce("left", "kept"))).alias("kept_sha256"),
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("passages", none).alias("passages"),
    )


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.withColumn("n_passages", F.size("passages").cast("long")).drop("spans", "passages")


def brute_force(rows: list[tuple], size: int = SIZE) -> pd.DataFrame:
    """The same by counting every window: for tests."""
    import pandas as pd

    count: dict[bytes, int] = {}
    texts = [(i, _bytes(t)) for i, t in rows]
    for _, data in texts:
        for k in range(len(data) - size + 1):
            w = data[k : k + size]
            count[w] = count.get(w, 0) + 1
    out = []
    for i, data in texts:
        spans = covered([(k, k + 1) for k in range(len(data) - size + 1) if count[data[k : k + size]] > 1], size)
        kept, at = b"", 0
        for a, b in spans:
            kept += data[at:a]
            at = b
        kept += data[at:]
        out.append((i, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
