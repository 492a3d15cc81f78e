"""Token counts by a map-side two-tier lookup of pre-tokens."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretok, textnum
from .store import text_column
from .worker import held

def frequent_pre_tokens(docs: DataFrame, tasks: int = 8, task_docs: int = 500, size: int = 32_768) -> list[str]:
    """The most frequent pre-tokens of the first ``task_docs`` documents of about ``tasks`` partitions, ``size`` at most.

    They only warm the first tier: a count never depends on them, as what they lack goes to the second tier. Spark looks into
    a few partitions until ``tasks`` of them have answered, so neither the work nor what the driver gets grows with the table.
    """
    texts = docs.select(text_column(docs).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        left = task_docs
        for part, data, offsets in textnum.slices(batches, "text"):
            starts, ends, bounds, _ = pretok.split(data, offsets)
            raw, most = data.tobytes(), bounds[min(left, part.num_rows)]
            found.update(raw[a:b] for a, b in zip(starts[:most].tolist(), ends[:most].tolist(), strict=True) if b - a <= 64)
            left -= part.num_rows
            if left <= 0:
                break
        best = found.most_common(size)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([[p.decode() for p, _ in best]]), pa.array([[n for _, n in best]])], ["pieces", "n"])

    merged: Counter = Counter()
    for row in texts.mapInArrow(counted, "pieces array<string>, n array<long>").take(tasks):
        for piece, n in zip(row.pieces, row.n, strict=True):
            merged[piece] += n
    return [p for p, _ in merged.most_common(size)]


def length_table(tokenizer: str, frequent: list[str]) -> pretok.Table:
    """The first tier: numbers of tokens of frequent pre-tokens by fingerprint, a few MB at most; nothing else of them."""
    out = pretok.Table(1)
    if frequent:
        data, offsets = textnum.buffers(pa.array(frequent))
        lengths = [len(x) for x in pretok.Encoder(tokenizer).encoded(frequent)]
        out.put(*pretok.fingerprints(data, offsets[:-1], offsets[1:]), np.array(lengths, np.int32))
    return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, frequent: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``tokenizer`` is the path of a byte-level BPE file; counts are the library's for the whole text without added
    specials, while special strings inside a text count as the library's default has it. Null and empty texts
    have no bytes and no tokens; repeated rows and null ids are passed through; an empty table gives an empty one.
    First tier: a broadcast hash table of the lengths of frequent pre-tokens; second tier: each worker's cache, filled by the
    library. No pre-token is shuffled.
    """
    frequent = frequent_pre_tokens(docs) if frequent is None else frequent
    first = docs.sparkSession.sparkContext.broadcast(length_table(tokenizer, frequent))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("lengths", name), lambda: pretok.Encoder(tokenizer, first.value))
        for part, data, offsets in textnum.slices(batches, "text"):
            starts, ends, bounds, odd = pretok.split(data, offsets)
            sums = np.concatenate([[0], np.cumsum(encoder.numbers(data, starts, ends), dtype=np.int64)])
            counts = sums[bounds[1:]] - sums[bounds[:-1]]
            for i, ids in encoder.whole(data, offsets, odd).items():
                counts[i] = len(ids)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
