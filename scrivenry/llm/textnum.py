"""Vectorised words, shingles and fingerprints over Arrow string columns.

Works on the UTF-8 bytes of a whole batch at once: word limits come from byte classes, a word's 64-bit
fingerprint from its bytes taken eight at a time, a shingle's from the fingerprints of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: White space as in the contracts: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_STEPS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: Masks of the first 0 to 8 bytes of a little-endian block.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: Slices of more bytes than this are digested one by one.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of data[start:end] for each slice of bytes; other seeds give independent ones.

    Each step scrambles the state with the next eight bytes, so that there is no algebra under which structured texts
    collide; long slices are digested by BLAKE2b.
    """
    sizes = ends - starts
    out = mix(sizes.astype(U64) * U64(_BASE) + U64(seed * 0xD6E8FEB86659FD93 % 2**64))
    blocks = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    long = sizes > LONG
    live = np.flatnonzero((sizes > 0) & ~long)
    at = 0
    while len(live):
        room = np.minimum(sizes[live] - at, 8)
        out[live] = mix(out[live] ^ (blocks[starts[live] + at] & _MASKS[room]))
        at += 8
        live = live[room == 8]
        live = live[sizes[live] > at]
    if long.any():
        raw, salt = data.tobytes(), seed.to_bytes(8, "little")
        for i in np.flatnonzero(long).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, salt=salt).digest(), "little")
    return out


def strings(column: pa.Array) -> pa.Array:
    """The column as strings without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()).fill_null("") if column.null_count or column.type != pa.string() else column


def buffers(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array, without a copy."""
    kinds = column.buffers()
    offsets = np.frombuffer(kinds[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(kinds[2], np.uint8) if kinds[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with at most ``limit`` bytes of text (or one longer row): rows, bytes, offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = buffers(strings(batch.column(batch.schema.get_field_index(column))))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and fingerprints of all words, and each text's first word number (one more entry than texts).

    A word is a run of bytes that ``outside`` doesn't mark; with ``fold`` A-Z count as lower case.
    """
    inside = ~outside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    now = np.zeros(len(data) + 1, bool)
    now[:-1] = inside
    starts = np.flatnonzero(now & (~before | edge))
    ends = np.flatnonzero(before & (~now | edge))
    return starts, ends, slice_hashes(LOWER[data] if fold else data, starts, ends), np.searchsorted(starts, offsets)


def short_salt(n: int) -> np.uint64:
    """What tells a whole sequence of ``n`` words from a shingle."""
    return U64(n * _BASE % 2**64)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each text's k-word shingles in order, and bounds by text.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(bounds)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    limits = np.concatenate([[0], np.cumsum(sizes)])
    n = len(hashes)
    full = np.zeros(n, U64)
    for j in range(k):
        full[: max(0, n - j)] += hashes[j:] * _STEPS[j]
    last = np.repeat(bounds[1:], counts)
    valid = np.arange(n) + k <= last
    out = np.empty(limits[-1], U64)
    place = np.repeat(counts >= k, sizes)
    out[place] = full[valid]
    short = (counts > 0) & (counts < k)
    own = np.zeros(short.sum(), U64)
    first, count = bounds[:-1][short], counts[short]
    for j in range(k - 1):
        has = count > j
        own[has] += hashes[first[has] + j] * _STEPS[j]
    out[limits[:-1][short]] = own + count.astype(U64) * U64(_BASE)
    return mix(out), limits
