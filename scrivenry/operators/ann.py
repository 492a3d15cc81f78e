"""Approximate vector search: an inverted file of cells with 8-bit codes, rights and filters inside the probe, exact scores at the end."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import access
from .retrieval import CANDIDATES, query_blocks, ranked

#: Vectors that cells are learned from at most, cells at most, cells a question probes at least, and candidates by codes for each wanted hit.
SAMPLE, MOST_CELLS, PROBES, FACTOR = 50_000, 4_096, 8, 3


@dataclass(frozen=True)
class VectorIndex:
    """Unit centroids, the rows (cell, key, code, scale and what filters need), counts of rows by cell and right, and the vectors."""

    centroids: np.ndarray
    rows: DataFrame
    counts: DataFrame
    vectors: DataFrame
    key: str


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-30)


def _learned(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: unit centroids; a cell that loses all its vectors starts again at the one worst served."""
    rng = np.random.default_rng(11)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = sample @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(near.max(axis=1))[: len(empty)]]
        centres = _unit(sums)
    return centres


def build(passages: DataFrame, key: str = "chunk_id", cells: int | None = None) -> VectorIndex:
    """Index all passages with a vector; the cells are learned from ``SAMPLE`` of them at most, taken by a hash of the key.

    A vector is a unit vector in the index, coded as 8-bit numbers with a scale of its own. Rows lie ordered by cell, so a probe
    reads the row groups of its cells. There are about as many cells as the square root of the rows, ``MOST_CELLS`` at most.
    """
    rows = passages.where("vector IS NOT NULL")
    n = rows.count()
    cells = min(MOST_CELLS, max(1, cells or round(n**0.5)), max(1, n))
    share = min(1.0, SAMPLE / max(1, n))
    chosen = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(max(1, int(share * 1_000_000))))
    taken = chosen.select(F.col("vector").cast("array<float>").alias("v")).limit(2 * SAMPLE).toPandas().v
    taken = taken if len(taken) else rows.select(F.col("vector").cast("array<float>").alias("v")).limit(1).toPandas().v
    centres = _learned(_unit(np.stack(taken.to_numpy()).astype(np.float32)), cells) if len(taken) else np.zeros((0, 1), np.float32)

    def coded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            v = _unit(np.stack(pdf.pop("v").to_numpy()).astype(np.float32))
            scale = np.maximum(np.abs(v).max(axis=1), 1e-30) / 127
            codes = np.rint(v / scale[:, None]).astype(np.int8)
            yield pdf.assign(cell=(v @ centres.T).argmax(axis=1), scale=scale.astype(float), code=[c.tobytes() for c in codes])

    others = [c for c in ("doc_type", "tags", "created_at") if c in passages.columns]
    kept = rows.select(F.col("vector").cast("array<float>").alias("v"), key, access.rights_of().alias("rights"), *others)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.drop("v").schema) + ", cell int, scale double, code binary"
    cell_rows = staged(kept.mapInPandas(coded, schema).repartitionByRange("cell", key).sortWithinPartitions("cell"), "cells")
    counts = staged(cell_rows.select("cell", F.explode("rights").alias("token")).groupBy("cell", "token").count(), "counts")
    return VectorIndex(centres, cell_rows, counts, staged(rows.select(key, "vector"), "vectors").select(key, F.col("vector").cast("array<double>").alias("vector")), key)


def nearest(index: VectorIndex, queries: DataFrame, most: int = CANDIDATES, allowed=None, probes: int = PROBES, block: int = 4_096) -> DataFrame:
    """(qid, key, score, rank): for each query nearly its ``most`` nearest passages that its caller may see.

    ``allowed`` is a predicate on the filters' columns; it and the caller's rights hold inside the probe, before anything is cut
    off. A query probes the cells nearest to it, ``probes`` at least and as many as it takes until they hold ``FACTOR`` times
    ``most`` rows for its rights. Of these, ``FACTOR`` times ``most`` by codes are scored by their vectors. ``retrieval.nearest`` is the exact way.
    """
    out = None
    for part in query_blocks(queries.where("vector IS NOT NULL"), block):
        found = _block(index, part, most, allowed, probes)
        out = found if out is None else out.unionByName(found)
    wanted = queries.select("qid", F.col("vector").cast("array<double>").alias("asked"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    both = out.join(index.vectors, index.key).join(wanted, "qid")
    cosine = F.aggregate(F.zip_with("vector", "asked", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (norm("vector") * norm("asked"))
    return ranked(both.select("qid", index.key, F.round(cosine, 6).alias("score")), most, key=index.key)


def _block(index: VectorIndex, queries: DataFrame, most: int, allowed, probes: int) -> DataFrame:
    held = queries.select("qid", F.col("vector").cast("array<float>").alias("vector"), access.tokens_of().alias("tokens")).orderBy("qid").collect()
    key, wanted = index.key, FACTOR * most
    schema = f"qid long, {key} {index.rows.schema[key].dataType.simpleString()}, near double"
    if not held or not len(index.centroids):
        return index.rows.sparkSession.createDataFrame([], schema).drop("near")
    vectors = _unit(np.array([q.vector for q in held], np.float32))
    ids = np.array([q.qid for q in held])
    numbers = {t: i for i, t in enumerate(sorted({t for q in held for t in q.tokens}))}
    holds = np.zeros((len(numbers), len(held)), np.float32)
    for j, q in enumerate(held):
        holds[[numbers[t] for t in q.tokens], j] = 1
    # Rows that each caller's rights open in a cell, at most: a row counts once for each right. Cells times the block's rights.
    open_rows = np.zeros((len(index.centroids), len(numbers)), np.float32)
    for r in index.counts.where(F.col("token").isin(list(numbers))).collect():
        open_rows[r.cell, numbers[r.token]] = r["count"]
    order = np.argsort(-(vectors @ index.centroids.T), axis=1, kind="stable")
    reached = np.cumsum(np.take_along_axis((open_rows @ holds).T, order, axis=1), axis=1) - np.take_along_axis((open_rows @ holds).T, order, axis=1)
    use = (np.arange(order.shape[1]) < probes) | (reached < wanted)
    probed = np.zeros((len(index.centroids), len(held)), bool)
    for j in range(len(held)):
        probed[order[j][use[j]], j] = True

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, rows = [], 0
        for pdf in parts:
            for cell, own in pdf.groupby("cell"):
                asking = np.flatnonzero(probed[cell])
                own = own.reset_index(drop=True)
                tokens = own.rights.explode().map(numbers).dropna()
                grants = np.zeros((len(own), len(numbers)), np.float32)
                grants[tokens.index.to_numpy(), tokens.to_numpy(np.int64)] = 1
                codes = np.frombuffer(b"".join(own.code), np.int8).reshape(len(own), -1).astype(np.float32) * own.scale.to_numpy(np.float32)[:, None]
                i, j = np.nonzero(grants @ holds[:, asking] > 0)
                scores = (codes @ vectors[asking].T)[i, j]
                kept.append(pd.DataFrame({"qid": ids[asking[j]], key: own[key].to_numpy()[i], "near": scores.astype(float)}))
                rows += len(i)
                if rows > 4 * wanted * len(held):
                    kept = [first(pd.concat(kept))]
                    rows = len(kept[0])
        if kept:
            yield first(pd.concat(kept))

    def first(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["qid", "near", key], ascending=[True, False, True]).groupby("qid").head(wanted)

    cells = index.rows.where(F.col("cell").isin(np.flatnonzero(probed.any(axis=1)).tolist()))
    cells = (cells if allowed is None else cells.where(allowed)).select("cell", key, "rights", "scale", "code")
    found = cells.mapInPandas(best, schema)
    return ranked(found.withColumnRenamed("near", "score"), wanted, key=key).select("qid", key)
