"""Passages that earlier documents have too, found by run-length indexes of what recurs.

Each window of ``length`` bytes has an anchor: of its pieces of ``PIECE`` bytes the one with the smallest hash, so equal windows have equal
anchors. Anchors of one document only are screened out; windows around the others go, as segments that share an anchor, to
that anchor's bucket. A bucket's different segments make a run-length index, matching statistics of the segments are streamed
through it, and the sampled ranges tell in which document a window stands first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .rindex import RunLengthIndex
from .store import new_path, stage_table, text_column

U64 = np.uint64
PIECE = 20
#: Bytes of text in a chunk and of segments in a bucket, anchors in a bucket of anchors, files of the chunked table.
CHUNK_BYTES, BUCKET_BYTES, BUCKET_ANCHORS, FILES = 4 << 20, 4 << 20, 500_000, 10_000
#: Anchors in more chunks than this are split by where in the window they stand, ``SHIFTS`` places together.
HOT, SHIFTS = 256, 4
#: Windows of a block: its arrays stay in a core's cache.
_WINDOWS = 1 << 18
#: Stands for no document, and for a row without id, whose text counts as later than all.
NONE = np.iinfo(np.int64).max


def _anchor_places(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash at each place of a piece, and for each window the place of its anchor, the first of the smallest."""
    n = len(data)
    blocks = np.ndarray(n + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    tail = U64((1 << 8 * (PIECE - 16)) - 1)
    m = n - PIECE + 1
    hashes = textnum.mix(blocks[:m] * U64(0x9E3779B97F4A7C15) ^ (blocks[8 : m + 8] * U64(0xD6E8FEB86659FD93) >> U64(7)) + (blocks[16 : m + 16] & tail) * U64(0xBF58476D1CE4E5B9))
    low = U64(_WINDOWS * 2 - 1)
    least = hashes & ~low | np.arange(m, dtype=U64)
    span, width = 1, length - PIECE + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return hashes, (least & low).astype(np.int64)


def windows(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows that lie within a text, in blocks: start, anchor's place and anchor's hash of each."""
    sizes = np.diff(offsets)
    begins, ends = offsets[:-1][sizes >= length], offsets[1:][sizes >= length] - length + 1
    for at in range(0, len(data) - length + 1, _WINDOWS):
        part = data[at : at + _WINDOWS + length - 1]
        hashes, place = _anchor_places(part, length)
        edge = np.zeros(len(place) + 1, np.int32)
        np.add.at(edge, np.clip(begins - at, 0, len(place)), 1)
        np.add.at(edge, np.clip(ends - at, 0, len(place)), -1)
        start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        place = place[start]
        yield start + at, place + at, hashes[place]


def _in(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is among the sorted values, and where."""
    at = np.minimum(np.searchsorted(sorted_values, x), max(0, len(sorted_values) - 1))
    return (sorted_values[at] == x if len(sorted_values) else np.zeros(len(x), bool)), at


def _texts(rows: pa.Table, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for part, data, offsets in textnum.slices(iter(rows.to_batches()), "text", limit):
        yield part, data, offsets, part.column(part.schema.get_field_index("doc")).to_numpy()


def _lists(limits: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(limits.astype(np.int64)), pa.array(values)).cast(pa.list_(pa.from_numpy_dtype(values.dtype)))


def _binary(limits: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(limits) - 1, [None, pa.py_buffer(limits.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _anchored(length: int, buckets: int, key: tuple, rows: pa.Table) -> pa.Table:
    """A chunk's different anchors by bucket; those of several documents of the chunk come first."""
    hashes, docs = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for _, data, offsets, doc in _texts(rows):
        for start, place, found in windows(data, offsets, length):
            new = np.ones(len(place), bool)
            new[1:] = place[1:] != place[:-1]
            hashes.append(found[new])
            docs.append(doc[np.searchsorted(offsets, start[new], "right") - 1])
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.argsort(h)
    h, d = h[order], d[order]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head) if len(h) else np.zeros(0, bool)
    h = h[head]
    bucket = (textnum.mix(h) % U64(buckets)).astype(np.int64)
    order = np.lexsort((~several, bucket))
    h, bucket, several = h[order], bucket[order], several[order]
    names, at = np.unique(bucket, return_index=True)
    limits = np.append(at, len(h))
    multi = np.add.reduceat(several.astype(np.int64), at) if len(h) else np.zeros(0, np.int64)
    return pa.table([pa.array(names.astype(np.int32)), pa.array(np.full(len(names), key[0].as_py()), pa.int32()), pa.array(multi), _binary(limits * 8, h.view(np.uint8))], ["bucket", "chunk", "multi", "anchors"])


def _shared(most: int, rows: pa.Table) -> pa.Table:
    """Of a bucket's anchors those that several documents have, for each chunk, and which are in more than ``most`` chunks."""
    own = [np.frombuffer(x.as_py(), U64) for x in rows["anchors"]]
    multi = rows["multi"].to_pylist()
    names, often = np.unique(np.concatenate(own), return_counts=True)
    known = often > 1
    known[np.searchsorted(names, np.concatenate([x[:n] for x, n in zip(own, multi, strict=True)]))] = True
    names, often = names[known], often[known]
    kept = [(x[has], often[at[has]] > most) for x, (has, at) in ((x, _in(names, x)) for x in own)]
    limits = np.cumsum([0, *(len(x) for x, _ in kept)])
    return pa.table([rows["chunk"], _binary(limits * 8, np.concatenate([x for x, _ in kept]).view(np.uint8)), _binary(limits, np.concatenate([x for _, x in kept]).view(np.uint8))], ["chunk", "anchors", "hot"])


def _anchors_of(hits: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's shared anchors in order, and which are hot."""
    anchors = np.concatenate([np.zeros(0, U64), *(np.frombuffer(x.as_py(), U64) for x in hits["anchors"] if x.is_valid)])
    hot = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_py(), np.uint8) for x in hits["hot"] if x.is_valid)])
    order = np.argsort(anchors)
    return anchors[order], hot[order] > 0


def segments(data: np.ndarray, offsets: np.ndarray, length: int, anchors: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one shared anchor: first window, number of windows, fingerprint of the bytes, key of the bucket.

    Windows around a hot anchor are also parted by its place in them, and the bytes that all windows of such a part have are its key.
    """
    parts = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, U64)] * 2]
    for start, place, found in windows(data, offsets, length):
        # Windows in a row mostly have one anchor, which is looked up once.
        head = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
        has, at = (np.repeat(x, np.diff(np.append(head, len(place)))) for x in _in(anchors, found[head]))
        start, place, found, at = start[has], place[has], found[has], at[has]
        if not len(start):
            continue
        is_hot = hot[at]
        shift = np.where(is_hot, (place - start) // SHIFTS, -1)
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (shift[1:] != shift[:-1]) | (np.diff(start) != 1)
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(start)))
        first, keys = start[head], found[head]
        last = first + count - 1
        ids = textnum.mix(textnum.slice_hashes(data, first, first + length) ^ textnum.slice_hashes(data, last, last + length, 1) * U64(3) + count.astype(U64))
        split = np.flatnonzero(is_hot[head])
        core = place[head][split] - shift[head][split] * SHIFTS
        keys[split] = textnum.slice_hashes(data, core, core + length - SHIFTS + 1, 2)
        parts.append([first, count, ids, keys])
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segmented(length: int, buckets: int, key: tuple, rows: pa.Table, hits: pa.Table) -> pa.Table:
    """A chunk's different segments by bucket, each with the least and the greatest document that has it."""
    out = []
    anchors, hot = _anchors_of(hits)
    ids, keys, docs, sizes, texts = [], [], [], [], []
    for _, data, offsets, doc in _texts(rows):
        first, count, own, bucket = segments(data, offsets, length, anchors, hot)
        owner = doc[np.searchsorted(offsets, first, "right") - 1]
        order = np.lexsort((owner, own))
        head = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1])) if len(order) else order
        at = order[head]
        ids.append(own[at]), keys.append(bucket[at]), sizes.append(count[at] + length - 1)
        docs.append((owner[at], np.maximum.reduceat(owner[order], head) if len(order) else owner))
        texts.append(_cut(data, first[at], sizes[-1]))
    empty = [np.zeros(0, np.int64)]
    ids, keys, sizes = np.concatenate([*ids, np.zeros(0, U64)]), np.concatenate([*keys, np.zeros(0, U64)]), np.concatenate([*sizes, *empty])
    least, most = np.concatenate([*(x for x, _ in docs), *empty]), np.concatenate([*(x for _, x in docs), *empty])
    data = np.concatenate([*texts, np.zeros(0, np.uint8)])
    starts = np.cumsum(sizes) - sizes
    # The same segment in several slices of the chunk.
    order = np.argsort(ids, kind="stable")
    head = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1])) if len(ids) else order
    if len(ids):
        least, most = np.minimum.reduceat(least[order], head), np.maximum.reduceat(most[order], head)
    at = order[head]
    bucket = (textnum.mix(keys[at] ^ U64(0xA5A5)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at, least, most, bucket = at[order], least[order], most[order], bucket[order]
    names, begins = np.unique(bucket, return_index=True)
    limits = np.append(begins, len(at))
    sizes = sizes[at]
    ends = np.append(0, np.cumsum(sizes))
    out = [pa.array(names.astype(np.int32)), pa.array(np.full(len(names), key[0].as_py()), pa.int32()), _lists(limits, ids[at].view(np.int64)), _lists(limits, least), _lists(limits, most), _lists(limits, sizes.astype(np.int32)), _binary(ends[limits], _cut(data, starts[at], sizes))]
    return pa.table(out, ["bucket", "chunk", "ids", "least", "most", "sizes", "bytes"])


def _cut(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of data one after another."""
    done = np.cumsum(sizes) - sizes
    return data[np.arange(int(sizes.sum())) + np.repeat(starts - done, sizes)]


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    return pa.concat_arrays([x.flatten() for x in rows[name].chunks]).to_numpy()


def _first_documents(length: int, rows: pa.Table) -> pa.Table:
    """For each chunk, runs of windows of its segments that stand first in a document before the segment's last."""
    ids, least, most, sizes = (_flat(rows, x) for x in ("ids", "least", "most", "sizes"))
    data = np.frombuffer(b"".join(x.as_py() for x in rows["bytes"]), np.uint8)
    per_row = np.concatenate([np.diff(x.offsets.to_numpy()) for x in rows["ids"].chunks])
    chunk = np.repeat(rows["chunk"].to_numpy(), per_row)
    sizes = sizes.astype(np.int64)
    names, which = np.unique(ids, return_inverse=True)
    one = np.empty(len(names), np.int64)
    one[which] = np.arange(len(ids))
    owner = np.full(len(names), NONE)
    np.minimum.at(owner, which, least)
    latest = np.full(len(names), np.iinfo(np.int64).min)
    np.maximum.at(latest, which, most)
    size = sizes[one]
    text = _cut(data, (np.cumsum(sizes) - sizes)[one], size)
    offsets = np.append(0, np.cumsum(size))
    index = RunLengthIndex(text, offsets, owner, length)
    lengths, places = index.statistics(text, offsets)
    first = index.earliest(lengths, places, NONE)
    # Windows in a row of one segment with one first document.
    seg = np.repeat(np.arange(len(names)), size)
    at = np.arange(len(text)) - np.repeat(offsets[:-1], size)
    window = np.flatnonzero((at <= size[seg] - length) & (first < latest[seg]))
    seg, at, first = seg[window], at[window], first[window]
    new = np.ones(len(seg), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (np.diff(window) > 1) | (first[1:] != first[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(seg)))
    seg, at, first = seg[head], at[head], first[head]
    # Back to each chunk that has the segment in a later document.
    low, high = np.searchsorted(seg, which), np.searchsorted(seg, which, "right")
    times = high - low
    run = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    row = np.repeat(np.arange(len(ids)), times)
    late = first[run] < most[row]
    row, run = row[late], run[late]
    order = np.argsort(chunk[row], kind="stable")
    row, run = row[order], run[order]
    to, begins = np.unique(chunk[row], return_index=True)
    limits = np.append(begins, len(row))
    return pa.table([pa.array(to.astype(np.int32)), *(_lists(limits, x) for x in (ids[row], at[run].astype(np.int32), count[run].astype(np.int32), first[run]))], ["chunk", "ids", "at", "count", "first"])


def _marked(length: int, rows: pa.Table, found: pa.Table) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk with the bytes that stay and the runs of bytes that go."""
    is_hit = found["anchors"].is_valid()
    anchors, hot = _anchors_of(found.filter(is_hit))
    runs = found.filter(pc.invert(is_hit))
    ids, at, count, owner = (_flat(runs, x) if len(runs) else np.zeros(0, np.int64) for x in ("ids", "at", "count", "first"))
    order = np.argsort(ids)
    ids, at, count, owner = ids[order], at[order].astype(np.int64), count[order].astype(np.int64), owner[order]
    for part, data, offsets, doc in _texts(rows):
        first, _, own, _ = segments(data, offsets, length, anchors, hot) if len(ids) else (np.zeros(0, np.int64), None, np.zeros(0, U64), None)
        own = own.view(np.int64)
        low, high = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
        times = high - low
        run = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        start = np.repeat(first, times) + at[run]
        later = doc[np.searchsorted(offsets, start, "right") - 1] > owner[run]
        start, run = start[later], run[later]
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + count[run] + length - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        limit = np.zeros(len(data) + 1, bool)
        limit[offsets] = True
        before, now = np.append(False, gone), np.append(gone, False)
        begins, ends = np.flatnonzero(now & (~before | limit)), np.flatnonzero(before & (~now | limit))
        spans = np.searchsorted(begins, offsets)
        pairs = pa.StructArray.from_arrays([pa.array(x - offsets[np.searchsorted(offsets, begins, "right") - 1]) for x in (begins, ends)], ["start", "end"])
        kept = _binary(np.append(0, np.cumsum(~gone))[offsets], data[~gone])
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), pairs), kept], ["doc_id", "n_bytes", "spans", "kept"])


def without_repeated_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (start, end of the maximal runs of removed bytes), kept (the bytes that stay).

    Texts are UTF-8 bytes; a byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller doc_id.
    Strings overlap, never cross documents, and are judged on the input. Null texts count as empty; texts under
    ``length`` bytes stay whole. Rows with one id don't remove from each other; rows without an id count as later than all others and,
    among each other, as one document. Repeated rows have a result each. Other columns are ignored; an empty table gives an
    empty one.

    Texts are shuffled once, into a table of chunks by their digest, so most copies share a chunk; digests that are frequent, at most
    1,000, are dealt over all chunks. Chunks send each different anchor and segment once, so what many documents have is
    aggregated before each shuffle; a task holds a chunk of about 4 MB (or one longer text) or a bucket of about as many bytes. An
    anchor in many chunks is split by its place in the window: a bucket then holds what shares 47 bytes.
    """
    if length < PIECE + 8:
        raise ValueError(f"strings of {PIECE + 8} bytes or more")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    sized = texts.select(F.octet_length("text").cast("long").alias("size"), F.xxhash64("text").alias("digest"))
    counted = stage_table(sized.groupBy("digest").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "digests")
    n_rows, n_bytes = counted.agg(F.sum("n"), F.sum("size")).first()
    chunks = max(1, -(-(n_bytes or 0) // CHUNK_BYTES))
    frequent = counted.where(F.col("n") >= max(100, (n_rows or 0) // 1000)).select("digest", F.lit(True).alias("frequent"))
    dealt = texts.withColumn("digest", F.xxhash64("text")).join(F.broadcast(frequent), "digest", "left")
    salt = F.when(F.col("frequent"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("digest", salt), F.lit(chunks)).cast("int"))
    chunked = _chunked(dealt.select("chunk", "doc_id", F.coalesce("doc_id", F.lit(int(NONE))).alias("doc"), "text"), chunks)

    own = chunked.select("chunk", "doc", "text").groupBy("chunk")
    n = max(1, chunks * CHUNK_BYTES // (BUCKET_ANCHORS * 16))
    anchors = own.applyInArrow(lambda key, rows: _anchored(length, n, key, rows), "bucket int, chunk int, multi long, anchors binary")
    most = HOT
    hits = stage_table(anchors.groupBy("bucket").applyInArrow(lambda rows: _shared(most, rows), "chunk int, anchors binary, hot binary"), "hits")
    n_hits = hits.agg(F.sum(F.octet_length("anchors"))).first()[0] or 0
    buckets = max(1, n_hits // 8 * (length + 14) // BUCKET_BYTES)
    pieces = own.cogroup(hits.groupBy("chunk")).applyInArrow(
        lambda key, rows, known: _segmented(length, buckets, key, rows, known), "bucket int, chunk int, ids array<long>, least array<long>, most array<long>, sizes array<int>, bytes binary"
    )
    owned = pieces.groupBy("bucket").applyInArrow(lambda rows: _first_documents(length, rows), "chunk int, ids array<long>, at array<int>, count array<int>, first array<long>")
    found = hits.unionByName(stage_table(owned, "owned"), allowMissingColumns=True)
    return chunked.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(lambda rows, known: _finished(length, rows, known), "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def _finished(length: int, rows: pa.Table, found: pa.Table) -> pa.Table:
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    return pa.Table.from_batches(list(_marked(length, rows, found)), kinds)


def _chunked(dealt: DataFrame, chunks: int) -> DataFrame:
    """The texts as a table bucketed by chunk: what is grouped by chunk later doesn't shuffle them again."""
    files = min(chunks, FILES)
    path = new_path(dealt.sparkSession, "chunks")
    name = "chunks_" + path.rsplit("-", 1)[1]
    dealt.repartition(files, "chunk").write.bucketBy(files, "chunk").sortBy("chunk").option("path", path).saveAsTable(name)
    return dealt.sparkSession.table(name)


def passage_report(found: DataFrame) -> DataFrame:
    """Numbers of bytes and runs that go, and a digest of what stays."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
