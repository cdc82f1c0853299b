"""Vectorised 64-bit SimHash fingerprints of 3-word shingles (numpy only)."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
SHINGLE = 3

# XXH64 primes: fixed values of the published hash.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_rows(rows: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each row of an (n, length) uint8 matrix with length < 32."""
    n, length = rows.shape
    h = np.full(n, np.uint64(seed) + P5 + np.uint64(length), dtype=np.uint64)
    at = 0
    while at + 8 <= length:
        lane = np.ascontiguousarray(rows[:, at : at + 8]).view("<u8").ravel()
        h = _rotl(h ^ (_rotl(lane * P2, 31) * P1), 27) * P1 + P4
        at += 8
    if at + 4 <= length:
        lane = np.ascontiguousarray(rows[:, at : at + 4]).view("<u4").ravel().astype(np.uint64)
        h = _rotl(h ^ (lane * P1), 23) * P2 + P3
        at += 4
    for k in range(at, length):
        h = _rotl(h ^ (rows[:, k].astype(np.uint64) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def hash_slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[start:start+length] for every slice; short slices of one length are hashed together."""
    out = np.empty(len(starts), dtype=np.uint64)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    raw = None
    for part in np.split(order, edges):
        if not len(part):
            continue
        length = int(lengths[part[0]])
        if length < 32:
            out[part] = xxh64_rows(data[starts[part][:, None] + np.arange(length)], seed)
        else:
            raw = data.tobytes() if raw is None else raw
            out[part] = [xxhash.xxh64_intdigest(raw[s : s + length], seed) for s in starts[part].tolist()]
    return out


def fingerprints(texts: list[str | None], words_per_batch: int = 100_000) -> np.ndarray:
    """One uint64 per text; null counts as empty, a text without words gives zero."""
    out = np.zeros(len(texts), dtype=np.uint64)
    pending: list[tuple[int, bytes, int]] = []
    size = 0
    for k, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if words:
            pending.append((k, b" ".join(words), len(words)))
            size += len(words)
        if size >= words_per_batch:
            _flush(pending, out)
            pending, size = [], 0
    _flush(pending, out)
    return out


def _flush(pending: list[tuple[int, bytes, int]], out: np.ndarray) -> None:
    if not pending:
        return
    data = np.frombuffer(b" ".join(p[1] for p in pending), dtype=np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(data)]))
    words = np.array([p[2] for p in pending])
    first = np.concatenate(([0], np.cumsum(words)[:-1]))
    shingles = np.maximum(words - SHINGLE + 1, 1)
    at = np.concatenate(([0], np.cumsum(shingles)[:-1]))
    head = np.arange(int(shingles.sum())) - np.repeat(at - first, shingles)
    tail = head + np.repeat(np.minimum(words, SHINGLE) - 1, shingles)
    h = hash_slices(data, starts[head], ends[tail] - starts[head])
    counts = _bit_counts(h, at, shingles)
    bits = (counts * 2 > shingles[:, None]).astype(np.uint8)
    out[[p[0] for p in pending]] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _bit_counts(h: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many hashes of each run have each of the 64 bits (bit 0 first)."""
    out = np.zeros((len(at), 64), dtype=np.int64)
    step = 1 << 14
    raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    ends = at + sizes
    for lo in range(0, len(h), step):
        hi = min(lo + step, len(h))
        a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(at, hi, "left")
        bits = np.unpackbits(raw[lo:hi], axis=1, bitorder="little")
        sums = np.zeros((hi - lo + 1, 64), dtype=np.uint32)
        np.cumsum(bits, axis=0, dtype=np.uint32, out=sums[1:])
        out[a:b] += sums[np.minimum(ends[a:b], hi) - lo].astype(np.int64) - sums[np.maximum(at[a:b], lo) - lo]
    return out
