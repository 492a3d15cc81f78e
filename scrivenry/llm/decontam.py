"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the size of their shingle sets (powers of two). For a partition of upper size ``u`` a document is
seen as blocks of ``u`` consecutive shingles, so the sets compared are of like size whatever the document's length. A
block that shares a MinHash coordinate with an item makes the pair a candidate: each of an item's coordinates whose
shingle is in the document hits with a probability of about a half or more, so a pair at the threshold is
missed by all coordinates about once in ten million.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .store import text_column
from .worker import held

COORDINATES = 64
#: Items of up to this many shingles are searched with blocks of one shingle.
TINY = 8
_MULTIPLIERS = np.random.default_rng(99).integers(1, 2**63, COORDINATES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = re.compile("[^\\x20\\x09-\\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


class _Values:
    """Values to find with their items: a bit table before the sorted values."""

    def __init__(self, values: np.ndarray, items: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values, self.items = values[order], items[order]
        self.bits = np.zeros(1 << 18, bool)
        self.bits[self._low(values)] = True

    @staticmethod
    def _low(x: np.ndarray) -> np.ndarray:
        return ((x >> np.uint64(20)) & np.uint64((1 << 18) - 1)).astype(np.int64)

    def hits(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position, item) of all matches."""
        at = np.flatnonzero(self.bits[self._low(x)])
        low, high = np.searchsorted(self.values, x[at]), np.searchsorted(self.values, x[at], "right")
        for i, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            for j in range(a, b):
                yield i, int(self.items[j])


def word_list(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def shingle_set(words: list[str], k: int) -> set[tuple[str, ...]]:
    """All distinct ``k``-word shingles; fewer words are one shingle, none are none."""
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


class Items:
    """The search structures of a block of items, built once per worker."""

    def __init__(self, rows: list[tuple[int, str]], k: int):
        self.k = k
        self.ids = [i for i, _ in rows]
        self.sets = [shingle_set(word_list(t), k) for _, t in rows]
        data, offsets = textnum.buffers(pa.array([t for _, t in rows], pa.string()))
        _, _, hashes, bounds = textnum.words(data, offsets)
        found, limits = textnum.shingles(hashes, bounds, k)
        counts = np.diff(bounds)
        by_class: dict[int, list[int]] = {}
        self.short: dict[int, _Values] = {}
        short: dict[int, list[int]] = {}
        for i, n in enumerate(counts.tolist()):
            if 0 < n < k:
                short.setdefault(n, []).append(i)
            elif n:
                size = len(self.sets[i])
                by_class.setdefault(1 if size <= TINY else 1 << math.ceil(math.log2(size)), []).append(i)
        for n, own in short.items():
            self.short[n] = _Values(found[limits[own]], np.array(own))
        self.classes: dict[int, list[_Values]] = {}
        for u, own in sorted(by_class.items()):
            parts = [found[limits[i] : limits[i + 1]] for i in own]
            if u == 1:
                self.classes[u] = [_Values(np.concatenate(parts), np.repeat(own, [len(p) for p in parts]))]
            else:
                self.classes[u] = [_Values(np.array([(p * m).min() for p in parts]), np.array(own)) for m in _MULTIPLIERS]

    def candidates(self, hashes: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) positions that share a coordinate."""
        out: set[tuple[int, int]] = set()
        found, limits = textnum.shingles(hashes, bounds, self.k)
        of = lambda edges, i: int(np.searchsorted(edges, i, "right")) - 1
        for values in self.classes.get(1, []):
            out.update((of(limits, i), j) for i, j in values.hits(found))
        blocked = [u for u in self.classes if u > 1]
        if blocked and len(found):
            base = blocked[0]
            sizes = np.diff(limits)
            starts, edges = _blocks(sizes, limits[:-1], base)
            coarse = {u: _blocks(np.diff(edges), edges[:-1], u // base) for u in blocked}
            for c, m in enumerate(_MULTIPLIERS):
                least = np.minimum.reduceat(found * m, starts)
                for u in blocked:
                    own = least if u == base else np.minimum.reduceat(least, coarse[u][0])
                    out.update((of(coarse[u][1], i), j) for i, j in self.classes[u][c].hits(own))
        for n, values in self.short.items():
            if len(hashes) >= n:
                sums = sum((hashes[j : len(hashes) - n + 1 + j] * textnum._STEPS[j] for j in range(n)), np.zeros(len(hashes) - n + 1, np.uint64))
                grams = textnum.mix(sums + textnum.short_salt(n))
                out.update((of(bounds, i), j) for i, j in values.hits(grams) if i + n <= bounds[of(bounds, i) + 1])
        return out


def _blocks(sizes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of each run's blocks of ``width``, and bounds by run."""
    counts = -(-sizes // width)
    edges = np.concatenate([[0], np.cumsum(counts)])
    inner = np.arange(edges[-1]) - np.repeat(edges[:-1], counts)
    return np.repeat(firsts, counts) + inner * width, edges


def _verified(items: Items, part: pa.RecordBatch, column: int, data: np.ndarray, offsets: np.ndarray, least: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item position, item's shingles, shared ones) of each pair whose exact containment reaches ``least``."""
    _, _, hashes, bounds = textnum.words(data, offsets)
    by_row: dict[int, list[int]] = {}
    for i, j in sorted(items.candidates(hashes, bounds)):
        by_row.setdefault(i, []).append(j)
    for i, found in by_row.items():
        words = word_list(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8"))
        own: dict[int, set] = {}
        for j in found:
            wanted = items.sets[j]
            width = len(next(iter(wanted)))
            if width not in own:
                own[width] = shingle_set(words, width) if len(words) >= width else set()
            both = len(wanted & own[width])
            if both >= least * len(wanted):
                yield i, j, len(wanted), both


#: Bytes of item texts in a block, about: what the driver and each task hold of them.
BLOCK_BYTES = 16 << 20


def item_blocks(items: DataFrame, block_items: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_items`` and ``BLOCK_BYTES``, one block at a time on the driver."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_column(items).alias("text")).distinct()
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    n = max(1, math.ceil(count / block_items), math.ceil(size / BLOCK_BYTES))
    for i in range(n):
        yield [(r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, least: float = 0.8, block_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) of each item that a document contains.

    Containment is the share of the item's distinct ``k``-word shingles (A-Z lower-cased, words split at white space)
    that the document has; ``least`` or more counts. An item of fewer words is one shingle of its own length. Items
    without words, and null or wordless documents, match nothing; an item_id with several texts is searched for each of
    them, and so is an item without an id; a repeated document row repeats its rows; other columns are ignored; empty tables give an empty result. Items are
    broadcast in blocks of ``block_items`` and ``BLOCK_BYTES`` of text, each of which is searched in all documents.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    out = None
    schema = "doc_id long, item_id long, item_shingles long, shared long"
    for block in item_blocks(items, block_items):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = _items(sent, k)
            for part, data, offsets in textnum.slices(batches, "text"):
                rows = list(_verified(found, part, 1, data, offsets, least))
                if rows:
                    at, which, size, both = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array([found.ids[j] for j in which], pa.int64()), pa.array(size, pa.int64()), pa.array(both, pa.int64())], ["doc_id", "item_id", "item_shingles", "shared"])

        own = texts.mapInArrow(run, schema)
        out = own if out is None else out.unionByName(own)
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def decontaminated(docs: DataFrame, items: DataFrame, k: int = 5, least: float = 0.8, block_items: int = 20_000) -> DataFrame:
    """The documents that contain no item, all columns as they are; null and wordless texts stay.

    Works where the documents are: nothing is shuffled.
    """
    spark = docs.sparkSession
    out = docs
    for block in item_blocks(items, block_items):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = _items(sent, k)
            for part, data, offsets in textnum.slices(batches, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[[i for i, *_ in _verified(found, part, 1, data, offsets, least)]] = False
                yield part.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def _items(block, k: int) -> Items:
    name, rows = block.value
    return held(("items", name, k), lambda: Items(rows, k))
