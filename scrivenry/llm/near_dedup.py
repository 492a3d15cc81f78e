"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard, connected components.

Circulant MinHash takes two permutations of a universe of hash slots: the first scatters a shingle's slot, the second,
shifted circularly by one more place for each coordinate, ranks it. One gather of a contiguous run of the second
permutation gives all coordinates of a shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .components import connected_components
from .store import rows_that_stay, stage_table, text_column
from .worker import held

UNIVERSE_BITS = 20
MISS = 1e-7
#: Buckets up to this many members are compared as pairs, larger ones block by block.
SMALL = 32


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold is missed by all bands with probability ``MISS`` at most."""
    rows = 6 if percent >= 83 else 5
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows)), rows


def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and for each slot its ranks in all shifts of the ranking permutation."""

    def build() -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(1_234_567)
        first = rng.permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        ranks = rng.permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        return first, sliding_window_view(np.concatenate([ranks, ranks[: coordinates - 1]]), coordinates)

    return held(("permutations", coordinates), build)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The circulant MinHash of one non-empty set of shingle fingerprints."""
    first, ranks = permutations(coordinates)
    slots = first[(shingles >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
    out = np.full(coordinates, 1 << UNIVERSE_BITS, np.uint32)
    for at in range(0, len(slots), 2048):
        np.minimum(out, ranks[slots[at : at + 2048]].min(axis=0), out=out)
    return out


def set_fingerprint(own: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that tell a set of distinct shingles from others."""
    return textnum.mix(own).sum(dtype=np.uint64), textnum.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)


def _signed(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in textnum.slices(batches, "text"):
            _, _, hashes, bounds = textnum.words(data, offsets)
            found, limits = textnum.shingles(hashes, bounds, k)
            n = part.num_rows
            sizes, low, high = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            signed = np.zeros((n, bands * rows), np.uint32)
            for i in range(n):
                own = found[limits[i] : limits[i + 1]]
                if len(own):
                    own = np.unique(own)
                    sizes[i], (low[i], high[i]) = len(own), set_fingerprint(own)
                    signed[i] = signature(own, bands * rows)
            keys = np.zeros((n, bands), np.uint64)
            for r in range(rows):
                keys = textnum.mix(keys + signed[:, r::rows].astype(np.uint64) + np.uint64(r + 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), lists], ["doc_id", "text_hash", "n_shingles", "low", "high", "bands"])

    return run


def _shingled(k: int):
    """The shingle sets of classes (parallel lists ``reps`` and ``lows``) that a row's text may stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in textnum.slices(batches, "text"):
            _, _, hashes, bounds = textnum.words(data, offsets)
            found, limits = textnum.shingles(hashes, bounds, k)
            reps, sets = [], []
            for i, (own_reps, lows) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                own = np.unique(found[limits[i] : limits[i + 1]])
                low = int(set_fingerprint(own)[0].view(np.int64))
                for rep in (r for r, x in zip(own_reps, lows, strict=True) if x == low):
                    reps.append(rep)
                    sets.append(own)
            if reps:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(reps), lists], ["rep", "shingles"])

    return run


def spanning_links(ids: np.ndarray, parts: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Enough links to join all components that true links across the two sides (or within the one) connect."""
    codes, which = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(which, minlength=len(codes)) > 1
    number = np.cumsum(often) - 1
    owner, number = owner[often[which]], number[which[often[which]]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    rows, cols = (np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max()))
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        low, high = np.searchsorted(number, [at, at + 4096])
        dense = np.zeros((len(sets), 4096), np.float32)
        dense[owner[low:high], number[low:high] - at] = 1
        common[np.ix_(rows, cols)] += dense[rows] @ dense[cols].T
    x, y = np.nonzero((100 * common[np.ix_(rows, cols)] >= percent * (sizes[rows][:, None] + sizes[cols][None, :] - common[np.ix_(rows, cols)])) & (parts[rows][:, None] != parts[cols][None, :]))
    root: dict[int, int] = {}
    out = []
    for i, j in zip(rows[x].tolist(), cols[y].tolist(), strict=True):
        a, b = parts[i], parts[j]
        while root.get(a, a) != a:
            a = root[a]
        while root.get(b, b) != b:
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _block_links(percent: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["rep", "block"])
        found = spanning_links(rows.rep.to_numpy(), rows.component.to_numpy(), rows.block.to_numpy(), [np.asarray(x) for x in rows.shingles], percent) if rows.component.nunique() > 1 else []
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _block_pairs(split: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components in large buckets, compared block by block.

    A bucket's members are dealt by hash into blocks of one power-of-two size class, those of the bucket's main component
    apart from the others, and of about eight MB of shingles. Each pair of blocks that the length filter lets meet is
    one group, and only links leave it; blocks of the main component don't meet each other, so the work is that of the others
    times the bucket, not of the bucket squared.
    """
    size = F.floor(F.log2(F.col("n_shingles"))).cast("int")
    full = F.greatest(F.lit(16), F.least(F.lit(512), F.pow(F.lit(2), F.lit(20) - F.shiftright("level", 1)))).cast("long")
    marked = split.withColumn("level", size * 2 + (F.col("component") != F.col("main")).cast("int"))
    counted = marked.groupBy("band", "value", "level").agg(F.count("*").alias("m")).withColumn("deal", F.ceil(F.col("m") / full))
    levels = counted.groupBy("band", "value").agg(F.map_from_entries(F.collect_list(F.struct("level", "deal"))).alias("deals"))
    # Staged, so Spark sees that it's small and leaves the members where they are, however large a bucket is.
    dealt = marked.join(stage_table(levels, "levels"), ["band", "value"])
    deal = lambda x: F.coalesce(F.col("deals")[x], F.lit(0))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), deal(F.col("level"))).cast("int"))
    name = lambda x, y: x * F.lit(1 << 20) + y

    def blocks(other: Column) -> Column:
        # From 1, as a sequence from 0 to -1 would count down.
        met = (deal(other) > 0) & (F.col("level").bitwiseOR(other).bitwiseAND(1) == 1)
        return F.when(met, F.transform(F.sequence(F.lit(1), deal(other).cast("int")), lambda i: name(other, i - 1))).otherwise(F.array().cast("array<int>"))

    even = F.col("level").bitwiseAND(-2)
    mates = F.concat(*(blocks(even + d) for d in (-2, -1, 0, 1, 2, 3)))
    dealt = dealt.withColumn("block", name(F.col("level"), F.col("own"))).withColumn("mate", F.explode(mates))
    dealt = dealt.select("band", "value", "rep", "component", "block", F.least("block", "mate").alias("p"), F.greatest("block", "mate").alias("q"))
    return dealt.join(sets, "rep").groupBy("band", "value", "p", "q").applyInPandas(_block_links(percent), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full shingle sets reach the threshold."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    near = (100 * both >= percent * (F.size("sa") + F.size("sb") - both))
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of distinct ``k``-word shingles (A-Z lower-cased, words split at white
    space) have ``100 * intersection >= percent * union``; ``component_id`` is the smallest doc_id reachable and the
    document that has it is kept. Null or wordless texts have no shingles, link with nothing and are kept; texts under
    ``k`` words have their whole sequence as one shingle. Equal sets form one class, which is one node of the graph, so
    copies are never expanded into pairs. Repeated (doc_id, text) rows give repeated rows; an id with several texts has a
    row, and maybe a component, for each. Rows without an id link as others do but never name a component: it is
    null, and such rows are kept, only where no member has an id. Other columns are ignored. An empty table gives an empty one.

    Within a band's bucket, members are first checked against one centre, the member that shares most buckets
    with others; only members that are then still in another component than the bucket's largest are checked against the
    members of other components. Each step joins or aggregates pairs; no bucket is gathered into a task.
    """
    out = _linked_rows(docs, k, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (null without words) and its smallest doc_id, for each row."""
    bands, rows = banding(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    # By what a class finds its text again: the id or, without one, the text's hash.
    row_key = F.coalesce("doc_id", "text_hash").alias("row_key")
    signed = stage_table(texts.select("doc_id", "text", "text_hash").mapInArrow(_signed(k, bands, rows), "doc_id long, text_hash long, n_shingles long, low long, high long, bands array<long>"), "signed")
    key = ["n_shingles", "low", "high"]
    classes = signed.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("least"), F.min(row_key).alias("row_key"), F.first("bands").alias("bands"))
    classes = stage_table(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    placed = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "value"))
    shared = placed.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    buckets = stage_table(placed.join(shared, ["band", "value"]), "buckets")
    popular = buckets.groupBy("rep").agg(F.sum("n").alias("popular"))
    ranked = buckets.join(popular, "rep")
    centres = ranked.groupBy("band", "value").agg(F.min(F.struct((-F.col("popular")).alias("p"), F.col("rep").alias("c"), F.col("n_shingles").alias("nc"))).alias("m")).select("band", "value", "m.c", "m.nc")
    sized = lambda x, y: percent * F.greatest(x, y) <= 100 * F.least(x, y)
    stars = buckets.join(centres, ["band", "value"]).where((F.col("rep") != F.col("c")) & sized("n_shingles", "nc"))
    stars = stage_table(stars.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct(), "stars")

    wanted = buckets.select("rep").distinct()
    held = classes.join(wanted, "rep").groupBy("row_key").agg(F.collect_list(F.struct("rep", "low")).alias("x")).select("row_key", F.col("x.rep").alias("reps"), F.col("x.low").alias("lows"))
    full = texts.select("text", row_key).join(held, "row_key").select("text", "reps", "lows")
    full = stage_table(full.mapInArrow(_shingled(k), "rep long, shingles array<long>"), "sets")
    if full.count() > wanted.count():  # rows that repeat an id and a text
        full = stage_table(full.dropDuplicates(["rep"]), "sets")

    near = stage_table(_verified(stars, full, percent), "near")
    found = stage_table(connected_components(near), "found")
    labelled = buckets.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    counted = labelled.groupBy("band", "value", "component").agg(F.count("*").alias("m"))
    largest = counted.groupBy("band", "value").agg(F.max(F.struct("m", "component")).alias("x"), F.count("*").alias("parts")).where("parts > 1").select("band", "value", F.col("x.component").alias("main"))
    split = stage_table(labelled.join(largest, ["band", "value"]), "split")
    small, large = split.where(F.col("n") <= SMALL), split.where(F.col("n") > SMALL)
    minor = small.where("component <> main").select("band", "value", F.col("rep").alias("r"), F.col("n_shingles").alias("nr"), F.col("component").alias("cr"))
    rest = small.join(minor, ["band", "value"]).where((F.col("component") != F.col("cr")) & sized("n_shingles", "nr"))
    rest = rest.select(F.least("rep", "r").alias("a"), F.greatest("rep", "r").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = _verified(stage_table(rest, "rest"), full, percent).unionByName(_block_pairs(large, full, percent))
    links = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    final = stage_table(connected_components(links), "final")

    final = final.select(F.col("node").alias("rep"), "component")
    grouped = classes.select("rep", *key, "least").join(final, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of = grouped.join(least, "component").select(*key, "component", "component_id")
    out = signed.select("doc_id", "text_hash", *key).join(of, key, "left")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay, one for each group of near copies, all columns as they are.

    It is the row with the group's smallest doc_id; where several texts have that id, or no row has one, a hash of the text
    decides, and of equal rows one stays. Rows without words all stay.
    """
    rows = stage_table(_linked_rows(docs, k, percent), "linked")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    kept = F.col("component").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    decided = rows.join(first, "component", "left").select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_digest"), kept.alias("kept"), "component")
    return rows_that_stay(docs, F.xxhash64(text_column(docs)), decided.where("component is not null"))
