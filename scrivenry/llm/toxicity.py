"""Toxicity by a classifier chain of linear models over hashed word and prefix features.

Categories are predicted one after another: each later model also sees the earlier categories' probabilities, which in
training come from out-of-fold models, so that it learns from what it'll see when it scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .store import stage_table, text_column

#: Lengths in bytes of the prefixes that are features beside whole words.
PREFIXES = (4, 5, 6)
#: Not part of a word here: ASCII but for letters, digits and the apostrophe.
_OUTSIDE = np.array([c < 0x80 and not chr(c).isalnum() and c != 0x27 for c in range(256)])


@dataclass
class Chain:
    """A fitted chain: sorted feature hashes, and per category the weights (bias, earlier categories, features)."""

    categories: list[str]
    features: np.ndarray
    weights: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of all categories for rows of feature presence."""
        out = np.zeros((len(x), len(self.categories)))
        for c, w in enumerate(self.weights):
            out[:, c] = sigmoid(w[0] + out[:, :c] @ w[1 : 1 + c] + x @ w[1 + c :])
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 120, decay: float = 2e-4) -> np.ndarray:
    """Logistic regression with a small L2 penalty, by full-batch Adam; the bias comes first."""
    rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    w = np.zeros(x.shape[1] + 1, np.float32)
    w[0] = np.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        e = (sigmoid(w[0] + x @ w[1:]) - y).astype(np.float32)
        g = np.concatenate([[e.mean()], e @ x / len(y) + decay * w[1:]]).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, categories: list[str], features: np.ndarray) -> Chain:
    """One linear model per category in order; earlier probabilities are out-of-fold when later models learn."""
    seen = np.zeros((len(x), 0), np.float32)
    weights = []
    for c in range(len(categories)):
        own = np.hstack([seen, x])
        weights.append(fit_linear(own, labels[:, c]))
        held = np.zeros((len(x), 1), np.float32)
        for f in np.unique(folds):
            out = folds == f
            w = fit_linear(own[~out], labels[~out, c])
            held[out, 0] = sigmoid(w[0] + own[out] @ w[1:])
        seen = np.hstack([seen, held])
    return Chain(categories, features, weights)


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes of all words, a column for the word and one per prefix (0 where the word is shorter), and bounds."""
    starts, ends, hashes, bounds = textnum.words(data, offsets, _OUTSIDE)
    values = textnum.LOWER[data]
    columns = [hashes]
    for n in PREFIXES:
        long = ends - starts > n
        cut = textnum.slice_hashes(values, starts, np.minimum(starts + n, ends))
        columns.append(np.where(long, textnum.mix(cut + np.uint64(n)), np.uint64(0)))
    return np.stack(columns), bounds, hashes


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in textnum.slices(batches, "text"):
        found, bounds, _ = _hashed(data, offsets)
        own = [np.unique(found[:, bounds[i] : bounds[i + 1]]) for i in range(part.num_rows)]
        own = [x[x != 0].view(np.int64) for x in own]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32)), pa.array(np.concatenate(own) if own else []))
        yield pa.RecordBatch.from_arrays([part.column(0), lists], ["row", "features"])


def presence(data: np.ndarray, offsets: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Which features (sorted hashes) each text has."""
    out = np.zeros((len(offsets) - 1, len(features)), np.float32)
    if not len(features):
        return out
    found, bounds, _ = _hashed(data, offsets)
    bits = np.zeros(1 << 20, bool)
    bits[(features >> np.uint64(44)).astype(np.int64)] = True
    for column in found:
        at = np.flatnonzero(bits[(column >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(features, column[at]), len(features) - 1)
        hit = features[place] == column[at]
        out[np.searchsorted(bounds, at[hit], "right") - 1, place[hit]] = 1
    return out


def train(docs: DataFrame, labels: DataFrame, langs: tuple[str, ...] = ("en", "fr", "de", "es"), max_rows: int = 8_000, max_features: int = 1_024, folds: int = 5) -> Chain:
    """Fit the chain on ``max_rows`` labelled documents at most, chosen by a hash of their id.

    The categories are ``toxic`` in each language and then ``toxic`` as such; the features are the ``max_features`` words and
    prefixes whose presence tells most about a category. Labels that are null, or of documents that are absent, don't
    count; without any label all scores are near 0.
    """
    categories = [f"toxic_{x}" for x in langs] + ["toxic"]
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = stage_table(texts.join(F.broadcast(chosen), "doc_id"), "training").select("*", F.xxhash64("doc_id", "text").alias("row"))
    marks = [F.when(F.col("lang") == x, F.col("toxic")).otherwise(0) for x in langs] + [F.col("toxic")]
    marked = rows.select("row", *(m.alias(c) for m, c in zip(marks, categories, strict=True))).dropDuplicates(["row"])
    found = rows.select("row", "text").mapInArrow(_distinct, "row long, features array<long>")
    totals = marked.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in categories)).first()
    n = max(1, totals.n)
    counted = found.join(marked, "row").select(F.explode("features").alias("feature"), *categories).groupBy("feature").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in categories)).where("n >= 3")
    # Deviation of the feature's positives from what chance would give, in standard deviations.
    told = [F.abs(F.col(c) - F.col("n") * (totals[c] / n)) / F.sqrt(F.col("n") * max(totals[c] / n, 1e-6)) for c in categories]
    best = counted.orderBy(F.greatest(*told).desc(), "feature").limit(max_features).select("feature").collect()
    features = np.sort(np.array([r.feature for r in best], np.int64).view(np.uint64))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in textnum.slices(batches, "text"):
            x = presence(data, offsets, features)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(x.sum(axis=1))]).astype(np.int32)), pa.array(np.nonzero(x)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["row", "at"])

    sample = rows.select("row", "text").mapInArrow(present, "row long, at array<int>").dropDuplicates(["row"]).join(marked, "row").orderBy("row").collect()
    x = np.zeros((len(sample), len(features)), np.float32)
    for i, r in enumerate(sample):
        x[i, r["at"]] = 1
    y = np.array([[r[c] for c in categories] for r in sample], np.float32).reshape(len(sample), len(categories))
    parts = np.array([r["row"] % folds for r in sample], np.int64)
    return fit_chain(x, y, parts, categories, features)


def _batch_scores(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, chain: Chain) -> np.ndarray:
    return chain.scores(presence(data, offsets, chain.features))


def score(docs: DataFrame, chain: Chain, threshold: float = 0.2) -> DataFrame:
    """One row per document: doc_id, a probability per category, and ``is_toxic`` (the last one reaches ``threshold``).

    Null and empty texts have no features and get the chain's base rates. Repeated rows are scored each; other columns
    are ignored; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in textnum.slices(batches, "text"):
            p = _batch_scores(part, data, offsets, model.value)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p[:, c]) for c in range(p.shape[1]))], ["doc_id", *(f"p_{c}" for c in model.value.categories)])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    out = texts.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.categories))
    return out.withColumn("is_toxic", F.col(f"p_{chain.categories[-1]}") >= threshold)


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.2) -> DataFrame:
    """The documents that the chain doesn't reject, all columns as they are; nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in textnum.slices(batches, "text"):
            yield part.filter(pa.array(_batch_scores(part, data, offsets, model.value)[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)
