"""Ranked lexical search over inverted treaps.

A term's postings are a treap: a search tree by document and a heap by impact. All treaps of a question's terms are
traversed at once; a range of documents is left out when the maxima of the subtrees that cover it add up to less than the
k-th score so far.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum
from .store import drop, paths_of, stage_table, text_column

#: What parts terms: ASCII other than letters and digits.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:128] = [not chr(c).isalnum() for c in range(128)]
#: Bytes of questions answered at once: what the driver and each task hold of them.
BLOCK_BYTES = 4 << 20
#: Postings of a block of documents, and salts of a question's hits.
BLOCK_POSTINGS, SALTS = 1_000_000, 64
#: One block of documents in so many is searched first; what its k-th hits score is where the others start.
LEAD = 8


def _terms(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: number of terms; of all (text, known term) pairs: text, term's number, occurrences."""
    _, _, hashes, bounds = textnum.words(data, offsets, OUTSIDE)
    counts = np.diff(bounds)
    at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
    hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
    pairs, often = np.unique(np.repeat(np.arange(len(counts)), counts)[hit] * max(1, len(known)) + at[hit], return_counts=True)
    return counts, pairs // max(1, len(known)), pairs % max(1, len(known)), often


def _postings(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in textnum.slices(batches, "text"):
            counts, text, term, often = _terms(data, offsets, known)
            limits = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(limits, pa.array(x.astype(np.int32))) for x in (term, often)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts.astype(np.int64)), *lists], ["doc_id", "n", "terms", "often"])

    return run


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def treap(impacts: list[int]) -> tuple[int, list[int], list[int]]:
    """Root, left and right children (-1: none) of the treap over postings in document order."""
    left, right = [-1] * len(impacts), [-1] * len(impacts)
    spine: list[int] = []
    for i, x in enumerate(impacts):
        last = -1
        while spine and impacts[spine[-1]] < x:
            last = spine.pop()
        left[i] = last
        if spine:
            right[spine[-1]] = i
        spine.append(i)
    return (spine[0] if spine else -1), left, right


class InvertedTreaps:
    """The treaps of one block: postings by (term, document) in flat lists."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray):
        order = np.lexsort((docs, terms))
        terms, docs, impacts = terms[order], docs[order], impacts[order]
        names, begins = np.unique(terms, return_index=True)
        self.docs, self.impacts = docs.tolist(), impacts.tolist()
        self.left, self.right, self.roots = [], [], {}
        for name, b, e in zip(names.tolist(), begins.tolist(), np.append(begins, len(terms))[1:].tolist(), strict=True):
            root, left, right = treap(self.impacts[b:e])
            self.left += [x + b if x >= 0 else -1 for x in left]
            self.right += [x + b if x >= 0 else -1 for x in right]
            self.roots[name] = root + b

    def top(self, terms: list[int], k: int, least: int = 1) -> list[tuple[int, int]]:
        """The ``k`` best (document, score), scores of ``least`` or more, highest first, equal ones by document."""
        docs, impacts, left, right = self.docs, self.impacts, self.left, self.right
        nodes = [self.roots[t] for t in terms if t in self.roots]
        best: list[tuple[int, int]] = []  # (score, -document), the worst first
        # Ranges of documents with the topmost posting of each treap in them; those of the highest bound come first.
        queue = [(-sum(impacts[x] for x in nodes), 0, -1, 1 << 62, nodes)] if nodes else []
        tie = 0
        while queue:
            bound, _, low, high, nodes = heapq.heappop(queue)
            if -bound < (best[0][0] if len(best) == k else least):
                break
            doc = docs[max(nodes, key=impacts.__getitem__)]
            score, below, above = 0, [], []
            for x in nodes:
                # On the way down to ``doc``, the first posting on each side is that side's topmost.
                under = over = -1
                while x >= 0:
                    at = docs[x]
                    if at < doc:
                        if under < 0:
                            under = x
                        x = right[x]
                    elif at > doc:
                        if over < 0:
                            over = x
                        x = left[x]
                    else:
                        score += impacts[x]
                        if under < 0:
                            under = left[x]
                        if over < 0:
                            over = right[x]
                        break
                while under >= 0 and not low < docs[under] < doc:
                    under = right[under] if docs[under] <= low else left[under]
                while over >= 0 and not doc < docs[over] < high:
                    over = right[over] if docs[over] <= doc else left[over]
                if under >= 0:
                    below.append(under)
                if over >= 0:
                    above.append(over)
            if score >= least:
                if len(best) < k:
                    heapq.heappush(best, (score, -doc))
                elif (score, -doc) > best[0]:
                    heapq.heapreplace(best, (score, -doc))
            for lower, upper, side in ((low, doc, below), (doc, high, above)):
                if side:
                    most = sum(impacts[x] for x in side)
                    if most >= (best[0][0] if len(best) == k else least):
                        tie += 1
                        heapq.heappush(queue, (-most, tie, lower, upper, side))
        return [(-doc, score) for score, doc in sorted(best, key=lambda x: (-x[0], -x[1]))]


def _searched(items: list[tuple[int, list[int], int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(rows: pa.Table) -> pa.Table:
        ids = rows["doc_id"].combine_chunks()
        # A document's place in the order of ids, those without one last.
        place = pd.Series(ids.to_pandas()).sort_values(na_position="last", kind="stable").index.to_numpy()
        n = rows["n"].to_numpy().astype(np.int64)
        lists = rows["terms"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        terms = lists.flatten().to_numpy().astype(np.int64)
        tf = rows["often"].combine_chunks().flatten().to_numpy().astype(np.int64)
        rank = np.empty(len(n), np.int64)
        rank[place] = np.arange(len(n))
        m = 100 - 90 + (90 * n * n_docs) // max(1, n_terms)
        impacts = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes)))
        index = InvertedTreaps(terms, np.repeat(rank, sizes), impacts)
        found = [(item, int(place[doc]), score) for item, own, least in items for doc, score in index.top(own, k, least)]
        return pa.table([pa.array([x[0] for x in found], pa.int64()), ids.take(pa.array([x[1] for x in found], pa.int64())), pa.array([x[2] for x in found], pa.int64())], ["item_id", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, limit: int) -> Iterator[pa.Table]:
    """The questions in blocks of at most ``limit`` bytes of text (or one longer), each fetched on its own."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), text_column(items).alias("text"), F.octet_length(text_column(items)).cast("long").alias("size"))
    asked = stage_table(asked.withColumn("row", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.sum("size")).first()[0] or 0
    n = -(-size // (limit // 2)) or 1
    for b in range(n):
        yield asked.where(F.pmod(F.xxhash64("row"), F.lit(n)) == b).select("item_id", "text").toArrow()


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents for each item: item_id, rank (from 1), doc_id, score.

    Terms are runs of letters, digits and characters beyond ASCII, of whole texts, A-Z in lower case. A term that ``df`` of the
    N documents with terms hold weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); with tf occurrences in a document of n terms, where all
    have L, it scores w * ((10^9 tf) div (1000 tf + 8 m)), m = 10 + (90 n N) div L. Equal scores go by doc_id, those without one
    last, then as rows lie. Null and termless texts are neither found nor counted; items without terms, and empty tables,
    give no rows. Repeated rows are documents of their own; items that share an id, or lack one, are each ranked apart. Other columns
    are ignored.

    Documents are read once for each ``BLOCK_BYTES`` of items; their counts of the items' terms are staged. Treaps are built over
    blocks of documents, by a hash of the row; some blocks go first and give the others the score to reach. Each block's k best
    meet by item in two steps, by salt and at last.
    """
    out = None
    for block in _blocks(items, BLOCK_BYTES):
        hits = _ranked(docs, block, k)
        out = hits if out is None else out.unionByName(hits)
    return out


def _best(hits: DataFrame, k: int) -> DataFrame:
    """Each item's ``k`` best hits with their rank, found by salt first, so that no task takes all hits of an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("r") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")


def _ranked(docs: DataFrame, block: pa.Table, k: int) -> DataFrame:
    data, offsets = textnum.buffers(textnum.strings(block["text"]))
    known = np.unique(textnum.words(data, offsets, OUTSIDE)[2])
    _, text, term, _ = _terms(data, offsets, known)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    found = texts.mapInArrow(_postings(known), "doc_id long, n long, terms array<int>, often array<int>")
    # The row's number is staged with it, as it would differ when files are split otherwise.
    staged = stage_table(found.withColumn("row", F.monotonically_increasing_id()), "postings")
    n_docs, n_terms, n_postings = staged.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.sum(F.size("terms"))).first()
    df = np.zeros(len(known), np.int64)
    # One number for each term of the block's items, whose bytes are bounded.
    for t, n in staged.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[t] = n
    weights = np.array([weight(n_docs, n) for n in df.tolist()], np.int64)
    own = np.searchsorted(text, np.arange(len(offsets)))
    asked = [(i, term[own[i] : own[i + 1]].tolist(), 1) for i in range(len(offsets) - 1)]
    parts = max(1, -(-(n_postings or 0) // BLOCK_POSTINGS))
    dealt = staged.where(F.size("terms") > 0).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    lead = min(parts - 1, -(-parts // LEAD))

    def hits(rows: DataFrame) -> DataFrame:
        return rows.groupBy("part").applyInArrow(_searched(asked, weights, n_docs, n_terms or 0, k), "item_id long, doc_id long, score long")

    if lead:
        first = stage_table(_best(hits(dealt.where(F.col("part") < lead)), k), "lead")
        # The k-th score of each item of the block that has k hits by now.
        known_least = {r.item_id: r.score for r in first.where(F.col("rank") == k).select("item_id", "score").collect()}
        asked = [(i, t, known_least.get(i, 1)) for i, t, _ in asked]
        found = _best(first.select("item_id", "doc_id", "score").unionByName(hits(dealt.where(F.col("part") >= lead))), k)
    else:
        found = _best(hits(dealt), k)
    names = docs.sparkSession.createDataFrame(pa.table([pa.array(range(len(block)), pa.int64()), block["item_id"].combine_chunks()], ["item", "item_id"]))
    best = stage_table(found.withColumnRenamed("item_id", "item"), "best")
    drop(docs.sparkSession, *paths_of(staged))
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")
