"""SentencePiece encoding by forward filtering and backward sampling; lossless decoding.

The pieces of a SentencePiece model span a lattice over a text. A forward pass sums the weight of all
ways to reach each character; a backward pass draws pieces from the end in proportion to it. The draws
are a hash of the row's key and their place, so a segmentation is random but the same on every run,
executor and retry. A piece's weight falls with its rank in the model, 1 / (rank + 2) ** SHARPNESS.

No piece crosses the start of a word (spaces and what follows) or a character without a piece, so the
lattice falls into words; the forward pass is done once for every distinct word a worker holds, and the
backward pass for all words of a batch at once. Decoding is exact: a space is the model's space mark,
and a character without a piece, the space mark itself included, is spelled in byte pieces.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "piece_bpe_32k.model"
SHARPNESS = 1.0
SEED = 0
#: Words kept between batches of a worker; beyond it the worker starts anew, which changes no result.
HELD_WORDS = 600_000
#: Characters, most frequent in the model first, whose steps in the trie are a table.
DENSE = 64
#: Characters of text whose words are drawn together.
DRAWN_TOGETHER = 2_000_000
MARK = "▁"


class _Numbered(dict):
    """Words to numbers in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.room, self.used = np.empty(1024, dtype=dtype), 0

    def append(self, values: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.room):
            room = np.empty(need + need // 2, dtype=self.room.dtype)
            room[: self.used] = self.view()
            self.room = room
        self.room[self.used : need] = values
        self.used = need

    def view(self) -> np.ndarray:
        return self.room[: self.used]


class Lattice:
    def __init__(self, model: str, sharpness: float = SHARPNESS):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.bytes_of: list[bytes] = []
        self.weight: dict[str, tuple[float, int]] = {}
        self.byte_id = [0] * 256
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace(MARK, " ")
                self.bytes_of.append(text.encode())
                self.weight[text] = ((2.0 - sp.get_score(i)) ** -sharpness, i)
        known = sorted(c for c in self.weight if len(c) == 1)
        if any(re.search(r"[^ ] ", p) for p in self.weight):
            raise ValueError("a piece of the model crosses the start of a word")
        chars = "".join(re.escape(c) for c in known if c != " ")
        self.split = re.compile(f" *[{chars}]+| +|[^ {chars}]+").findall
        self._trie(known)
        self.clear()

    def _trie(self, known: list[str]) -> None:
        """A trie of the pieces as a sorted array of (node, character) keys, so that many texts walk it at once."""
        often = Counter(c for text in self.weight for c in text)
        known = sorted(known, key=lambda c: (-often[c], c))
        self.known = np.full(0x110000, -1, dtype=np.int32)
        self.known[[ord(c) for c in known]] = np.arange(len(known))
        self.width = len(known)
        children: dict[int, int] = {}
        pieces, logs = [-1], [0.0]
        for text, (weight, i) in self.weight.items():
            node = 0
            for c in text:
                key = node * self.width + int(self.known[ord(c)])
                node = children.get(key, 0)
                if not node:
                    node = children[key] = len(pieces)
                    pieces.append(-1)
                    logs.append(0.0)
            pieces[node], logs[node] = i, np.log(weight)
        self.keys = np.array(sorted(children), dtype=np.int64)
        self.child = np.array([children[k] for k in self.keys.tolist()], dtype=np.int64)
        self.dense = np.zeros((len(pieces), DENSE), dtype=np.int32)  # the children by frequent characters, looked up without a search
        by_node, by_char = self.keys // self.width, self.keys % self.width
        near = by_char < DENSE
        self.dense[by_node[near], by_char[near]] = self.child[near]
        self.node_piece, self.node_log = np.array(pieces, dtype=np.int32), np.array(logs)

    def clear(self) -> None:
        """Word k has a node for each of its ends, and a node an edge for each piece that ends there."""
        self.words = _Numbered()
        self.built = 0
        self.ends = _Grown(np.int64)
        self.first = _Grown(np.int64)
        self.share = _Grown(np.float64)
        self.back = _Grown(np.int32)
        self.piece = _Grown(np.int32)

    def _build(self) -> None:
        """The forward pass over all words that are new. An edge's share is the cumulative share in its node, 1 for the last."""
        new = list(islice(self.words, self.built, None))
        if not new:
            return
        self.built = len(self.words)
        plain = np.array([self.known[ord(w[0])] >= 0 for w in new])
        spelled = [w.encode("utf-8", "surrogatepass") for w, k in zip(new, plain.tolist(), strict=True) if not k]
        size = np.array([len(w) for w in new], dtype=np.int64)
        size[~plain] = [len(w) for w in spelled]
        before = int(self.ends.view()[-1]) if len(self.ends.view()) else 0
        ends = before + np.cumsum(size)
        first = ends - size
        made = [self._edges([w for w, k in zip(new, plain.tolist(), strict=True) if k], first[plain])]
        if spelled:  # characters without a piece: one way only, byte after byte
            raw = np.frombuffer(b"".join(spelled), dtype=np.uint8)
            sizes = size[~plain]
            inner = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            node = np.repeat(first[~plain], sizes) + inner
            made.append((node, np.ones(len(raw)), inner, np.array(self.byte_id)[raw]))
        node, share, back, piece = (np.concatenate(x) for x in zip(*made, strict=True))
        order = np.argsort(node, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], np.diff(node[order]) > 0)))  # every node has an edge
        self.first.append(len(self.share.view()) + heads)
        for column, values in ((self.share, share), (self.back, back), (self.piece, piece)):
            column.append(values[order])
        self.ends.append(ends)

    def _edges(self, words: list[str], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """node, share, start within the word, piece of all lattice edges, by node and start."""
        if not words:
            return (np.empty(0, dtype=np.int64),) * 4
        code = self.known[np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")].astype(np.int64)
        size = np.array([len(w) for w in words], dtype=np.int64)
        begin = np.cumsum(size) - size
        inner = np.arange(len(code)) - np.repeat(begin, size)
        stop = np.repeat(begin + size, size)
        at, state, depth = np.arange(len(code)), np.zeros(len(code), dtype=np.int64), 0
        starts, lasts, states = [], [], []
        while len(at):
            char = code[at + depth]
            child = self.dense[state, np.minimum(char, DENSE - 1)]
            rare = np.flatnonzero(char >= DENSE)
            if len(rare):
                key = state[rare] * self.width + char[rare]
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                child[rare] = np.where(self.keys[found] == key, self.child[found], 0)
            hit = child > 0
            at, state = at[hit], child[hit].astype(np.int64)
            ends = self.node_piece[state] >= 0
            starts.append(at[ends])
            lasts.append(at[ends] + depth)
            states.append(state[ends])
            depth += 1
            more = at + depth < stop[at]
            at, state = at[more], state[more]
        start, last, state = (np.concatenate(x) for x in (starts, lasts, states))
        order = np.lexsort((start, last))
        start, last, state = start[order], last[order], state[order]
        reach = np.zeros(len(code))  # log weight of all ways to the end of each character
        weight = np.empty(len(start))
        by_step = np.argsort(inner[last], kind="stable")
        bounds = np.searchsorted(inner[last][by_step], np.arange(int(size.max(initial=0)) + 1))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            e = by_step[lo:hi]
            s, t = start[e], last[e]
            w = self.node_log[state[e]] + np.where(inner[s] > 0, reach[s - 1], 0.0)
            heads = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            count = np.diff(np.append(heads, len(t)))
            top = np.maximum.reduceat(w, heads)
            w = np.exp(w - np.repeat(top, count))
            total = np.add.reduceat(w, heads)
            reach[t[heads]] = top + np.log(total)
            weight[e] = w / np.repeat(total, count)
        heads = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
        count = np.diff(np.append(heads, len(last)))
        run = np.cumsum(weight)
        run -= np.repeat(run[heads] - weight[heads], count)
        run[np.append(heads[1:], len(last)) - 1] = 1.0
        node = np.repeat(first, size)[last] + inner[last]
        return node, np.minimum(run, 1.0), inner[start], self.node_piece[state]

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of each text, drawn by its key."""
        if len(self.words) > HELD_WORDS:
            self.clear()
        number = self.words.__getitem__
        words: list[int] = []
        counts = []
        for text in texts:
            before = len(words)
            words.extend(map(number, self.split(text)))
            counts.append(len(words) - before)
        self._build()
        ends, first, share, back, piece = (x.view() for x in (self.ends, self.first, self.share, self.back, self.piece))
        word = np.array(words, dtype=np.int64)
        count = np.array(counts, dtype=np.int64)
        of_text = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        base = np.where(word > 0, ends[word - 1], 0) if len(word) else word
        at = ends[word] - base if len(word) else word
        state = _mix(np.array(keys, dtype=np.uint64)[of_text] + _mix(place.astype(np.uint64)))
        live = np.arange(len(word))
        taken = np.zeros(len(word), dtype=np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            state = _mix(state + np.uint64(0x9E3779B97F4A7C15))
            u = (state >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = first[base + at - 1]
            low = np.flatnonzero(share[edge] <= u)
            while len(low):
                edge[low] += 1
                low = low[share[edge[low]] <= u[low]]
            drawn.append((live, piece[edge]))
            at = back[edge].astype(np.int64)
            taken[live] += 1
            go = np.flatnonzero(at)
            live, at, base, state = live[go], at[go], base[go], state[go]
        last = np.cumsum(taken) - 1
        out = np.empty(int(taken.sum()), dtype="<u4")
        for step, (which, found) in enumerate(drawn):
            out[last[which] - step] = found
        sizes = np.bincount(of_text, weights=taken, minlength=len(texts)).astype(np.int64)
        return np.split(out, np.cumsum(sizes)[:-1]) if len(texts) else []

    def decode(self, ids: np.ndarray) -> str:
        """The exact text that was encoded."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def lattice(model: str, sharpness: float) -> Lattice:
    return Lattice(model, sharpness)


def row_key(key, seed: int = SEED) -> int:
    """The draws' seed of a row; a null key is a key like any other."""
    return xxhash.xxh64_intdigest(b"null" if key is None else str(key).encode(), seed)


def _grouped(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= DRAWN_TOGETHER:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _sample(model: str, sharpness: float, seed: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = lattice(model, sharpness)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _grouped(texts):
                part = texts[lo:hi]
                found = net.encode(part, [row_key(k, seed) for k in ids_of[lo:hi]])
                decoded = [net.decode(x) for x in found]
                columns = [
                    pa.array(ids_of[lo:hi], pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded], pa.string()),
                    pa.array([a == b for a, b in zip(decoded, part, strict=True)], pa.bool_()),
                ]
                names = ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "lossless"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def sample_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, sharpness: float = SHARPNESS, seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_sha256, lossless and, if wanted, ids.

    Null text counts as empty and has no ids. Rows with one key and text get one segmentation; null
    keys share a seed. Texts of any length are encoded whole. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_sample(model, sharpness, seed, with_ids), schema)


def op5_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_encode(table(spark, sf_dir, "documents"), with_ids=False)
