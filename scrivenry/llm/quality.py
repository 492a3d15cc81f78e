"""Quality by a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it. A chunk's input is its bytes, each through a learned embedding,
and how often a byte recurs at each small distance within the chunk. Learned filters score every chunk, the largest
activation of each filter over the whole text is kept, and these are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .store import text_column

CHUNK, STRIDE, WIDTH, FILTERS, LAGS = 64, 32, 6, 24, 24
FILTER_DECAY, OUTPUT_DECAY = 1e-5, 1e-4
#: Pairs of bytes at each distance within a chunk.
ROOM = CHUNK - np.arange(1, LAGS + 1)


@dataclass
class Network:
    """Byte embedding (256, WIDTH), filters (CHUNK * WIDTH + LAGS, FILTERS), their biases, and the output layer."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    output: np.ndarray
    shift: float


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte chunks (n, CHUNK), their recurrence rates (n, LAGS), and bounds by text.

    A text's last chunk is filled up with zero bytes; an empty text is one chunk of them.
    """
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-np.maximum(sizes - CHUNK, 0) // STRIDE) + 1)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    room = (counts - 1) * STRIDE + CHUNK
    begins = np.concatenate([[0], np.cumsum(room)])
    flat = np.zeros(begins[-1], np.uint8)
    flat[np.arange(len(data)) + np.repeat(begins[:-1] - offsets[:-1], sizes)] = data
    starts = np.repeat(begins[:-1], counts) + (np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts)) * STRIDE
    own = sliding_window_view(flat, CHUNK)[starts]
    again = np.empty((len(own), LAGS), np.float32)
    for lag in range(1, LAGS + 1):
        again[:, lag - 1] = (own[:, lag:] == own[:, :-lag]).mean(axis=1)
    return own, again, bounds


def _inputs(net: Network, own: np.ndarray, again: np.ndarray) -> np.ndarray:
    return np.hstack([net.embedding[own].reshape(len(own), -1), again])


def _activations(net: Network, own: np.ndarray, again: np.ndarray) -> np.ndarray:
    """(n, FILTERS), chunks taken a few thousand at a time."""
    active = np.empty((len(own), FILTERS), np.float32)
    for at in range(0, len(own), 4096):
        active[at : at + 4096] = _inputs(net, own[at : at + 4096], again[at : at + 4096]) @ net.filters + net.bias
    return active


def _packed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of a text as a view of its bytes, and their recurrences as counts."""
    again = chunks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[1]
    flat = np.zeros((len(again) - 1) * STRIDE + CHUNK, np.uint8)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    return sliding_window_view(flat, CHUNK)[::STRIDE], np.rint(again * ROOM).astype(np.uint8)


def _rates(counts: np.ndarray) -> np.ndarray:
    return (counts / ROOM).astype(np.float32)


def forward(net: Network, own: np.ndarray, again: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The probability of each text."""
    active = _activations(net, own, again)
    pooled = np.maximum(np.maximum.reduceat(active, bounds[:-1], axis=0), 0)
    z = pooled @ net.output + net.shift
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def gradients(net: Network, own: np.ndarray, again: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy and the penalties, by embedding, filters, biases, output and shift."""
    active = _activations(net, own, again)
    # Only the chunk with a filter's largest activation learns.
    best = np.stack([bounds[i] + active[bounds[i] : bounds[i + 1]].argmax(axis=0) for i in range(len(labels))])
    top = np.take_along_axis(active, best, axis=0)
    pooled = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.output + net.shift, -30, 30)))
    e = ((p - labels) / len(labels)).astype(np.float32)
    down = e[:, None] * net.output[None, :] * (top > 0)
    used, which = np.unique(best, return_inverse=True)
    grad = np.zeros((len(used), FILTERS), np.float32)
    np.add.at(grad, (which.reshape(best.shape), np.arange(FILTERS)[None, :]), down)
    back = grad @ net.filters.T
    embedded = np.zeros_like(net.embedding)
    np.add.at(embedded, own[used].ravel(), back[:, : CHUNK * WIDTH].reshape(-1, WIDTH))
    return [embedded, _inputs(net, own[used], again[used]).T @ grad + FILTER_DECAY * net.filters, grad.sum(axis=0), pooled.T @ e + OUTPUT_DECAY * net.output, np.array([e.sum()])]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.004, seed: int = 5) -> Network:
    """Train with Adam on the cross entropy over whole texts; the same data give the same network.

    Of a text it keeps the bytes and the recurrence counts; a batch's inputs are made a few thousand chunks at a time, so
    memory grows with the texts' bytes only.
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (256, WIDTH)).astype(np.float32), rng.normal(0, 0.08, (CHUNK * WIDTH + LAGS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    rate_of = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    if not len(labels) or labels.min() == labels.max():
        net.output[:] = 0
        net.shift = float(np.log(rate_of / (1 - rate_of)))
        return net
    parts = [_packed(t) for t in texts]
    state = [(np.zeros(s, np.float32), np.zeros(s, np.float32)) for s in (net.embedding.shape, net.filters.shape, net.bias.shape, net.output.shape, (1,))]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            own, again = np.concatenate([parts[i][0] for i in chosen]), _rates(np.concatenate([parts[i][1] for i in chosen]))
            bounds = np.concatenate([[0], np.cumsum([len(parts[i][0]) for i in chosen])])
            grads = gradients(net, own, again, bounds, labels[chosen])
            step += 1
            pace = rate * (0.5 if epoch >= 2 * epochs // 3 else 1)
            moves = []
            for (m, v), g in zip(state, grads, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                moves.append(pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
            net.embedding -= moves[0]
            net.filters -= moves[1]
            net.bias -= moves[2]
            net.output -= moves[3]
            net.shift -= float(moves[4][0])
    return net


def held_out(doc_id: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3_000, seed: int = 5) -> Network:
    """Fit on ``max_rows`` labelled documents at most, chosen by a hash of their id from rows that aren't held out.

    Texts are whole, as in scoring; what the driver gathers is bounded by the number of rows. Null labels and labels
    without a document don't count; of an id's several texts the least one is learnt, of its labels the larger.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text")).orderBy("doc_id")
    learnt = [(r.text.encode(), r.quality) for r in rows.toLocalIterator()]
    return fit([x for x, _ in learnt], np.array([y for _, y in learnt], np.float32), seed=seed)


def quality_scores(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score (higher: label 1 likelier), predicted (1 from ``threshold`` on).

    Null and empty texts are one chunk of zero bytes and get its score; repeated rows are scored each; other columns are
    ignored; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in textnum.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(forward(model.value, *chunks(data, offsets)))], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    out = texts.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
