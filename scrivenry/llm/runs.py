"""Maximal periodic runs of words by the method of Kolpakov and Kucherov.

A document's words are factorised (each factor is a new word or the longest piece seen before) by its suffix automaton. Runs that
touch or cross the border of two factors are found as Main does, from common extensions to both sides of the border; all
others lie inside a factor and are copied from that factor's earlier occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .store import text_column

U64 = np.uint64
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def factors(codes: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, earlier start or -1) of the Lempel-Ziv factors, which may overlap their earlier occurrence."""
    follow: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(codes):
        new = len(follow)
        follow.append({})
        length.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out, at, n = [], 0, len(codes)
    while at < n:
        state, end = 0, at
        while end < n and first[to := follow[state][codes[end]]] < end:
            state, end = to, end + 1
        if end == at:
            out.append((at, at + 1, -1))
            at += 1
        else:
            out.append((at, end, first[state] - (end - at) + 1))
            at = end
    return out


def _own_prefixes(x: list[int], count: int) -> list[int]:
    """For i < count, how long x and x[i:] agree."""
    n = len(x)
    out = [n] * min(count, 1)
    low = high = 0
    for i in range(1, count):
        k = min(high - i, out[i - low]) if i < high else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        if i + k > high:
            low, high = i, i + k
        out.append(k)
    return out


def _prefixes(x: list[int], y: list[int], count: int, own: list[int]) -> list[int]:
    """For i < count, how long x and y[i:] agree; ``own`` are those of x with itself."""
    n, m = len(x), len(y)
    out: list[int] = []
    low = high = 0
    for i in range(count):
        k = min(high - i, own[i - low]) if i < high else 0
        while k < n and i + k < m and x[k] == y[i + k]:
            k += 1
        if i + k > high:
            low, high = i, i + k
        out.append(k)
    return out


def runs(codes: list[int], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal runs with length >= max(least, exponent * period), by start, then period."""
    found: dict[tuple[int, int], int] = {}
    parts, n = factors(codes), len(codes)
    for i, (b, e, _) in enumerate(parts):
        before = b - parts[i - 1][0] if i else 0
        both = before + e - b
        # A run that ends here starts less than a period before the last factor, as what follows its first period would be one factor.
        most = (both - 1) // (exponent - 1)
        if most >= 1 and both - 1 + most >= least:
            _at_border(codes, b, e, min(b, before + most), most, least, exponent, found)
    # What touches the end of the last factor.
    if n and (before := n - parts[-1][0]) >= least:
        _at_border(codes, n, n, before, before // exponent, least, exponent, found)
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (s, t), p in found.items():
        by_start.setdefault(s, []).append((t, p))
    if by_start:
        for b, e, c in parts:
            if c >= 0 and e - b > least:
                end = c + e - b
                for s in range(c + 1, end - 1):
                    for t, p in by_start.get(s, ()):
                        if t < end:
                            by_start.setdefault(s + b - c, []).append((t + b - c, p))
    return sorted({(s, t - s, p) for s, ends in by_start.items() for t, p in ends}, key=lambda x: (x[0], x[2]))


def _at_border(codes: list[int], b: int, e: int, left: int, most: int, least: int, exponent: int, found: dict[tuple[int, int], int]) -> None:
    """The runs of period ``most`` or less that touch or cross the place ``b``, within ``left`` words before and ``e``."""
    ahead, behind = codes[b:e], codes[b - left : b][::-1]
    own = _own_prefixes(ahead, most + 1)
    own_back = _own_prefixes(behind, most + 1)
    here = min(most, len(ahead))
    back = _prefixes(behind, ahead[:here][::-1] + behind, here, own_back)
    there = min(most, left)
    forth = _prefixes(ahead, behind[:there][::-1] + ahead, there, own)
    spans = [(b - back[here - p], b + p + (own[p] if p < len(ahead) else 0), p) for p in range(1, here + 1)]
    spans += [(b - p - (own_back[p] if p < left else 0), b + forth[there - p], p) for p in range(1, there + 1)]
    n = len(codes)
    for s, t, p in spans:
        if t - s < least or t - s < exponent * p or found.get((s, t), p + 1) <= p:
            continue
        if (s and codes[s - 1] == codes[s - 1 + p]) or (t < n and codes[t] == codes[t - p]):
            continue  # cut off by the limits; another border finds it whole
        found[s, t] = p


def _need(k: int, least: int, exponent: int) -> int:
    """How often at least each ``k`` words in a row of a run stand in it."""
    return min((max(least, exponent * q) - k + 1) // q for q in range(1, least + k + 1))


def stretches(hashes: np.ndarray, bounds: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of words that can hold a run; no run reaches out of one.

    In a run every three words in a row recur, so what recurs too seldom within its stretch parts it, again and again.
    """
    k = next(k for k in (3, 2, 1) if _need(k, least, exponent) >= 2)
    n = len(hashes)
    grams = hashes.copy()
    for j in range(1, k):
        grams[: n - j] = textnum.mix(grams[: n - j] ^ np.roll(hashes, -j)[: n - j] * U64(2 * j + 1))
    counts = np.diff(bounds)
    live = np.arange(n) + k <= np.repeat(bounds[1:], counts)
    text = np.repeat(np.arange(len(counts)), counts)
    places = np.flatnonzero(live)
    while len(places):
        fresh = np.ones(len(places), bool)
        fresh[1:] = (np.diff(places) > 1) | (text[places[1:]] != text[places[:-1]])
        piece = np.cumsum(fresh)
        _, which, often = np.unique(textnum.mix(grams[places] + piece.astype(U64) * U64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        stays = (often[which] >= _need(k, least, exponent)) & (np.bincount(piece)[piece] >= least - k + 1)
        if stays.all():
            begins = places[fresh]
            ends = places[np.append(np.flatnonzero(fresh)[1:] - 1, len(places) - 1)] + k
            return list(zip(begins.tolist(), ends.tolist(), strict=True))
        places = places[stays]
    return []


def _found(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in textnum.slices(batches, "text"):
            starts, ends, hashes, bounds = textnum.words(data, offsets, fold=False)
            kept = np.ones(len(starts), bool)
            rows: list[list[dict[str, int]]] = [[] for _ in range(part.num_rows)]
            for b, e in stretches(hashes, bounds, least, exponent):
                row = int(np.searchsorted(bounds, b, "right")) - 1
                codes = np.unique(hashes[b:e], return_inverse=True)[1].tolist()
                for s, length, p in runs(codes, least, exponent):
                    kept[b + s + p : b + s + length] = False
                    rows[row].append({"start": b + s - int(bounds[row]), "length": length, "period": p})
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(rows, pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))), joined(data, offsets, starts, ends, bounds, kept)], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Each text's kept words with one space between."""
    s, e = starts[kept], ends[kept]
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[kept]
    gap = np.zeros(len(s), bool)
    gap[:-1] = owner[1:] == owner[:-1]
    edge = np.zeros(len(data) + 2, np.int32)
    np.add.at(edge, s, 1)
    np.add.at(edge, e + gap, -1)
    inside = np.cumsum(edge[: len(data)]) > 0
    out = data.copy()
    out[e[gap]] = 0x20
    limits = np.concatenate([[0], np.cumsum(inside)])[offsets].astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(limits), pa.py_buffer(out[inside]))


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period), collapsed (the text with each run cut to its first period).

    Words are split at white space and compared as they are. A run is a stretch of words with a smallest period q and at least
    max(``least``, ``exponent`` * q) words that no neighbour continues; runs come by start, then period. A word is dropped if
    any run has it after its first q words; kept words are joined by one space. Null and wordless texts have no run and collapse to
    an empty text. Ids aren't looked at: repeated rows, and rows without an id, have a result each. Other columns are ignored;
    an empty table gives an empty one. Nothing is shuffled. A task holds a slice of about 1 MB of texts (or one longer text) and an
    automaton of the longest stretch that can hold a run, of some 600 bytes a word.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return texts.mapInArrow(_found(least, exponent), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def spliced(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; in a tenth of the documents, by a hash of the id, a stretch of words is repeated up to the end."""
    space = r"[\x20\x09-\x0D]+"
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"), h.alias("h"))
    split = first.withColumn("w", F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", space), "")))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    sized = split.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), n - F.col("a"))
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def run_report(found: DataFrame) -> DataFrame:
    """The longest run of each document of ``periodic_runs``, and digests of all its runs and of its collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.n") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
