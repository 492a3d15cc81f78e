"""Packing documents into training sequences: first-fit decreasing over a tournament tree of bin capacities."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretok, textnum
from .store import stage_table, text_column
from .worker import held


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items taken by falling length (ties by position).

    The tree's leaves are the bins' free capacities, an inner node the larger of its two children: the walk down to the
    first bin with room takes a logarithm of the number of bins.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        if need > capacity:
            raise ValueError(f"an item of {need} exceeds the capacity of {capacity}")
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Each document's ids and ``end_id``, cut at multiples of ``capacity``: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("ids", tokenizer), lambda: pretok.Encoder(tokenizer, ids=True))
        for part, data, offsets in textnum.slices(batches, "text"):
            starts, ends, bounds, odd = pretok.split(data, offsets)
            place = encoder.numbers(data, starts, ends)
            whole = encoder.whole(data, offsets, odd)
            sizes = encoder.lengths[place].astype(np.int64)
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            flat = encoder.ids[np.repeat(encoder.begins[place] - (ends - sizes), sizes) + np.arange(total)]
            at = np.concatenate([[0], ends])[bounds]
            out: dict[str, list] = {"row": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
            for i in range(part.num_rows):
                ids = np.asarray(whole[i], "<u4") if i in whole else flat[at[i] : at[i + 1]]
                raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                n = len(raw) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    out["row"].append(i)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(raw[4 * start : 4 * (start + length)]))
                    out["doc_tokens"].append(n)
            ids = part.column(0).take(pa.array(out.pop("row"), pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in out.values())], ["doc_id", *out])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return texts.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, group_docs: int = 2_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids followed by ``end_id``, so a null or empty text is one id; each id lies in exactly one
    piece and each sequence holds ``capacity`` ids at most, gapless from offset 0. The pieces of about ``group_docs``
    documents are dealt to one group at random (a hash of the piece's row, so one long document spreads, and equal pieces too) and
    each group is packed by itself; sequence ids are unique across groups. Repeated
    rows are packed as often as they come, null ids like others; an empty table gives an empty one; other columns are ignored.
    """
    # Rows are numbered in a staged table, so that a piece has one number whatever is run again.
    staged = stage_table(pieces(docs, tokenizer, capacity, end_id).withColumn("piece_row", F.monotonically_increasing_id()), "pieces")
    # As many groups as documents make, and more where they are longer than a sequence.
    n = staged.agg(F.count_if(F.col("start") == 0), F.count("*")).first()
    groups = max(1, math.ceil(n[0] / group_docs), math.ceil(n[1] / (8 * group_docs)))
    cut = staged.withColumn("piece_group", F.pmod(F.xxhash64("piece_row"), F.lit(groups))).drop("piece_row")

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        group = rows.pop("piece_group").to_numpy(np.int64)
        return rows.assign(sequence_id=(group << 32) + bins, offset=offsets)

    return cut.groupBy("piece_group").applyInPandas(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
