"""Ranked retrieval for batches of queries: BM25, exact vector search, rank fusion, reranking, grouping by document.

A ranked result always has an explicit rank; ties are broken by the passage's id. Access filters come before anything
that cuts a list off.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import staged
from . import access

if TYPE_CHECKING:
    from .ann import VectorIndex
    from .keyword import KeywordIndex

K1, B, RRF_K, CANDIDATES, MOST = 1.2, 0.75, 60, 100, 50
#: Fields of keyword search and what each counts; a passage has the score of its best field.
BM25_FIELDS = {"content": 1.0, "section_title": 2.0}


@dataclass(frozen=True)
class Filters:
    """Optional filters: any of the types, all of the tags, dates inclusive."""

    doc_types: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    created_from: date | None = None
    created_to: date | None = None

    def __post_init__(self) -> None:
        for values in (self.doc_types, self.tags):
            if len(values) > 50 or any(not 1 <= len(v) <= 128 for v in values):
                raise ValueError("at most 50 values of 1 to 128 characters")
        if self.created_from and self.created_to and self.created_from > self.created_to:
            raise ValueError("created_from is after created_to")

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.doc_types:
            out = out & F.col("doc_type").isin(*self.doc_types)
        for tag in self.tags:
            out = out & F.array_contains("tags", tag)
        if self.created_from:
            out = out & (F.col("created_at") >= F.lit(self.created_from))
        if self.created_to:
            out = out & (F.col("created_at") < F.date_add(F.lit(self.created_to), 1))
        return out


def page_size(top_k: int | None, query: str) -> int:
    """How many results to return; a blank query or a size below 1 is refused."""
    if not query.strip() or (top_k is not None and top_k < 1):
        raise ValueError("a query needs text and a size of 1 or more")
    return min(top_k or 10, MOST)


def request_sizes(requests: DataFrame) -> DataFrame:
    """Requests (query, top_k) with ``size``, how many results to return, and ``problem`` where one is refused."""
    bad = F.col("query").isNull() | (F.length(F.trim("query")) == 0) | F.coalesce(F.col("top_k") < 1, F.lit(False))
    return requests.withColumn("size", F.when(~bad, F.least(F.coalesce("top_k", F.lit(10)), F.lit(MOST)))).withColumn("problem", F.when(bad, "a query needs text and a size of 1 or more"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


@dataclass(frozen=True)
class Words:
    """Passages with numbers in place of their texts, for one set of queries: of each field ``_n`` counts the words, ``_w`` has the numbers of those of ``terms`` that it holds, ``_t`` how often."""

    rows: DataFrame
    terms: list[str]
    fields: Mapping[str, float]


def words_of(passages: DataFrame, queries: DataFrame, keep: Sequence[str], fields: Mapping[str, float] = BM25_FIELDS) -> Words:
    """What keyword search needs of the passages, written once beside the columns to ``keep``: their texts are read once and not written."""
    terms = _terms(queries)
    return Words(staged(_coded(passages, terms, keep, fields), "words"), terms, fields)


def _terms(queries: DataFrame) -> list[str]:
    """The distinct words of all queries."""
    return sorted(r.term for r in queries.select(F.explode(tokens(F.coalesce("query", F.lit("")))).alias("term")).distinct().collect())


def _coded(passages: DataFrame, terms: list[str], keep: Sequence[str], fields: Mapping[str, float]) -> DataFrame:
    numbers = T.ArrayType(T.IntegerType())
    names = [f"_{x}{i}" for i in range(len(fields)) for x in "nwt"]
    schema = T.StructType([*(passages.schema[c] for c in keep), *(T.StructField(n, T.IntegerType() if n[1] == "n" else numbers) for n in names)])
    n_terms = len(terms)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for batch in batches:
            out = [batch.column(c) for c in keep]
            for i in range(len(fields)):
                lists = batch.column(f"_w{i}")
                lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                number = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(batch)), lengths)[number >= 0]
                pair, tf = np.unique(row * n_terms + number[number >= 0], return_counts=True)
                starts = pa.array(np.searchsorted(pair, np.arange(len(batch) + 1) * n_terms), pa.int32())
                out.append(pa.array(lengths, pa.int32()))
                out += [pa.ListArray.from_arrays(starts, pa.array(x, pa.int32())) for x in (pair % max(n_terms, 1), tf)]
            yield pa.RecordBatch.from_arrays(out, [*keep, *names])

    words = [tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"_w{i}") for i, f in enumerate(fields)]
    return passages.select(*keep, *words).mapInArrow(coded, schema)


def bm25(passages: DataFrame, queries: DataFrame, field: str = "content", key: str = "chunk_id") -> DataFrame:
    """(qid, key, score) by BM25 of every passage that shares a term with a query in one field."""
    return best_field(passages, queries, {field: 1.0}, key)


def best_field(passages: DataFrame | Words, queries: DataFrame, fields: Mapping[str, float] = BM25_FIELDS, key: str = "chunk_id") -> DataFrame:
    """(qid, key, score) of every passage that shares a term with a query in some field: the best of its fields' weighted BM25."""
    return _scored_words(passages, queries, None, fields, key, None, False, 1_024)


def best_words(
    passages: DataFrame | Words, queries: DataFrame, most: int = CANDIDATES, fields: Mapping[str, float] = BM25_FIELDS, key: str = "chunk_id", among: Column | None = None, everyone: bool = False, block: int = 1_024
) -> DataFrame:
    """(qid, key, score, rank): each query's ``most`` best by :func:`best_field`, scores rounded to six decimals, among what its caller may see.

    Statistics are of all passages, not of what a caller may see or of those that ``among`` lets through. Of passages with one key the
    best counts. Each task keeps its best per query, so only those are shuffled, and no posting is. With ``everyone`` there are no rights to look at. ``passages`` may
    be the :func:`words_of` these queries, which then have the columns for rights and ``among``, and fields of their own.
    """
    found = _scored_words(passages, queries, most, fields, key, among, not everyone, block)
    return ranked(found.groupBy("qid", key).agg(F.max("score").alias("score")), most, key=key)


def _scored_words(passages: DataFrame | Words, queries: DataFrame, most: int | None, fields: Mapping[str, float], key: str, among: Column | None, rights: bool, block: int) -> DataFrame:
    """Two passes over the passages' words: how many hold each of the queries' terms, then the scores, block by block of the queries."""
    if isinstance(passages, Words):
        every, terms, fields = passages.rows, passages.terms, passages.fields
        read = every if among is None else every.where(among)
    else:
        keep = [key, *(["acl_users", "acl_groups"] if rights else [])]
        terms = _terms(queries)
        every, read = (_coded(rows, terms, keep, fields) for rows in (passages, passages if among is None else passages.where(among)))
    if not terms:
        return every.sparkSession.createDataFrame([], _pair_schema(every, key))
    weighed = _statistics(every, terms, fields)
    out = None
    for part in query_blocks(queries, block):
        found = _scored_block(read, part, most, terms, weighed, key, rights)
        out = found if out is None else out.unionByName(found)
    return out


def _statistics(every: DataFrame, terms: list[str], fields: Mapping[str, float]) -> dict[int, tuple[float, float, np.ndarray]]:
    """Of each field that has words: its weight, its mean length and each term's idf."""
    # Beside its terms each passage has one row, of the number -1, for its length.
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), F.col(f"_n{i}").alias("length"), F.col(f"_w{i}").alias("numbers")) for i in range(len(fields)))))
    sized = every.select(each.alias("x")).select("x.*").where("length > 0").select("field", "length", F.explode(F.concat(F.array(F.lit(-1)), "numbers")).alias("number"))
    counts = sized.groupBy("field", "number").agg(F.count("*").alias("n"), F.sum("length").alias("length")).collect()
    whole = {r.field: (r.n, r.length / r.n) for r in counts if r.number < 0}
    idf = np.zeros((len(fields), len(terms)))
    for r in counts:
        if r.number >= 0:
            idf[r.field, r.number] = math.log(1 + (whole[r.field][0] - r.n + 0.5) / (r.n + 0.5))
    return {i: (w, whole[i][1], idf[i]) for i, w in enumerate(fields.values()) if i in whole}


def _scores(batch: pa.RecordBatch, fields: Mapping[int, tuple[float, float, np.ndarray]], asks: np.ndarray) -> np.ndarray:
    """A row's score for each query: the best of its fields. ``asks`` says which terms (rows) a query (column) has."""
    out = np.zeros((len(batch), asks.shape[1]))
    for i, (weight, mean, idf) in fields.items():
        lists = batch.column(f"_w{i}")
        term, tf = (x.flatten().to_numpy() for x in (lists, batch.column(f"_t{i}")))
        row = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        length = batch.column(f"_n{i}").to_numpy()[row]
        impact = weight * idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        own, place = np.unique(term, return_inverse=True)
        matrix = np.zeros((len(batch), len(own)))
        matrix[row, place] = impact
        np.maximum(out, matrix @ asks[own].astype(np.float64), out=out)
    return out


def _pair_schema(passages: DataFrame, key: str) -> str:
    return f"qid long, {key} {passages.schema[key].dataType.simpleString()}, score double"


def _scored_block(passages: DataFrame, queries: DataFrame, most: int | None, terms: list[str], fields: Mapping[int, tuple[float, float, np.ndarray]], key: str, rights: bool) -> DataFrame:
    """Scores a thousand passages at a time. ``fields`` have a weight, the mean length and each term's idf."""
    who = access.tokens_of() if rights else F.array().cast("array<string>")
    held = queries.select("qid", F.array_distinct(tokens(F.coalesce("query", F.lit("")))).alias("terms"), who.alias("tokens")).where(F.size("terms") > 0).orderBy("qid").collect()
    if not held:
        return passages.sparkSession.createDataFrame([], _pair_schema(passages, key))
    at = {t: i for i, t in enumerate(terms)}
    asks = np.zeros((len(terms), len(held)), bool)
    for j, q in enumerate(held):
        asks[[at[t] for t in q.terms], j] = True
    ids = np.array([q.qid for q in held])
    numbers = {t: i for i, t in enumerate(sorted({t for q in held for t in q.tokens}))}
    holds = np.zeros((len(numbers), len(held)), np.float32)
    for j, q in enumerate(held):
        holds[[numbers[t] for t in q.tokens], j] = 1

    def scored(batch: pa.RecordBatch) -> np.ndarray:
        out = _scores(batch, fields, asks)
        if rights:
            rows = batch.column("_rights")
            token = pd.Series(rows.flatten().to_numpy(zero_copy_only=False), dtype=object).map(numbers).to_numpy(np.float64)
            row = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))
            grants = np.zeros((len(batch), len(numbers)), np.float32)
            grants[row[~np.isnan(token)], token[~np.isnan(token)].astype(np.int64)] = 1
            out[grants @ holds <= 0] = 0
        return out

    def first(found: pd.DataFrame) -> pd.DataFrame:
        once = found.sort_values(["qid", "score", key], ascending=[True, False, True]).drop_duplicates(["qid", key])
        return once.groupby("qid").head(most)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows, least = [], 0, np.zeros(len(held))
        for batch in batches:
            for start in range(0, len(batch), 1_024):
                part = batch.slice(start, 1_024)
                scores = scored(part)
                if most is not None:
                    scores = np.floor(scores * 1e6 + 0.5) / 1e6
                    i, j = np.nonzero((scores > 0) & (scores >= least))
                else:
                    i, j = np.nonzero(scores)
                found = pd.DataFrame({"qid": ids[j], key: part.column(key).to_pandas().to_numpy()[i], "score": scores[i, j]})
                if most is None:
                    yield from arrow(found)
                    continue
                kept.append(found)
                rows += len(found)
                if rows > 4 * most * len(held):
                    kept = [first(pd.concat(kept))]
                    rows = len(kept[0])
                    # What a query's last place has; nothing below it comes in any more.
                    full = kept[0].groupby("qid").score.agg(["size", "min"])
                    full = full[full["size"] >= most]["min"]
                    least[np.searchsorted(ids, full.index.to_numpy())] = full.to_numpy()
        if kept:
            yield from arrow(first(pd.concat(kept)))

    def arrow(found: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(found), 65_536):
            yield pa.RecordBatch.from_pandas(found.iloc[start : start + 65_536], preserve_index=False)

    words = [f"_{x}{i}" for i in fields for x in "nwt"]
    return passages.select(key, *words, *([access.rights_of().alias("_rights")] if rights else [])).mapInArrow(best, _pair_schema(passages, key))


#: Passages of a block, scores of a group (but for a bin that has more), and bins for each doubling of a score.
ROWS, GROUP, BINS = 4_096, 1 << 20, 16


def field_ranks(passages: Words, queries: DataFrame, key: str = "chunk_id", size: int = 256) -> DataFrame:
    """(qid, key, rank) of all that :func:`best_field` scores, by score rounded to six decimals, then by key.

    The result is as large as its pairs, so no pair is shuffled: passages lie in blocks by ranges of the key, a block sends each query's distinct
    scores and how many passages have them, packed, to groups by query and range of scores, and gets back the rank at which each of its scores begins.
    """
    fields = _statistics(passages.rows, passages.terms, passages.fields)
    parts = max(1, math.ceil(passages.rows.count() / (2 * ROWS)))
    rows = passages.rows.repartitionByRange(parts, key).sortWithinPartitions(key)
    names = [key, *(f"_{x}{i}" for i in fields for x in "nwt")]
    blocks = staged(rows.select(*names).mapInArrow(_blocked, f"start {rows.schema[key].dataType.simpleString()}, part int, data binary"), "blocks")
    out = None
    for part in query_blocks(queries, size):
        found = _ranked_block(blocks, part, passages.terms, fields, key)
        out = found if out is None else out.unionByName(found)
    return out


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each ``ROWS`` rows in one, as Parquet, named by their first key and a number: int arrays are a third of what they are in a shuffle."""
    kept, part = [], 0
    for batch in batches:
        kept.append(batch)
        if sum(map(len, kept)) >= ROWS:
            table = pa.Table.from_batches(kept).combine_chunks()
            whole = len(table) // ROWS * ROWS
            for at in range(0, whole, ROWS):
                yield _block(table.slice(at, ROWS), part)
                part += 1
            kept = table.slice(whole).to_batches()
    if sum(map(len, kept)):
        yield _block(pa.Table.from_batches(kept), part)


def _block(table: pa.Table, part: int) -> pa.RecordBatch:
    data = pa.BufferOutputStream()
    pq.write_table(table, data, compression="zstd")
    return pa.RecordBatch.from_arrays([table.column(0).slice(0, 1).combine_chunks(), pa.array([part], pa.int32()), pa.array([data.getvalue().to_pybytes()], pa.binary())], ["start", "part", "data"])


def _rows_of(row: pa.RecordBatch) -> pa.RecordBatch:
    return pq.read_table(pa.BufferReader(row.column("data")[0].as_py())).combine_chunks().to_batches()[0]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as their differences, byte by byte of all, compressed."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) if len(steps) else b""


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that were :func:`packed`."""
    return np.cumsum(np.frombuffer(pa.decompress(data, n * 8, codec="zstd", asbytes=True), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()) if n else np.zeros(0, np.int64)


def _bins(scores: np.ndarray) -> np.ndarray:
    return np.floor(BINS * np.log2(scores + 1.0)).astype(np.int64)


def _ranked_block(blocks: DataFrame, queries: DataFrame, terms: list[str], fields: Mapping[int, tuple[float, float, np.ndarray]], key: str) -> DataFrame:
    held = queries.select("qid", F.array_distinct(tokens(F.coalesce("query", F.lit("")))).alias("terms")).where(F.size("terms") > 0).orderBy("qid").collect()
    at = {t: i for i, t in enumerate(terms)}
    asks = np.zeros((len(terms), len(held)), bool)
    for j, q in enumerate(held):
        asks[[at[t] for t in q.terms], j] = True
    ids = [q.qid for q in held]
    kind = blocks.schema["start"].dataType.simpleString()

    def scored(block: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query with some: which of a block's rows it finds, the best first and then by key, and their scores in millionths."""
        parts = [_scores(block.slice(s, 1_024), fields, asks) for s in range(0, len(block), 1_024)]
        for j in range(len(ids)):
            own = np.concatenate([p[:, j] for p in parts])
            places = np.nonzero(own)[0]
            score = np.floor(own[places] * 1e6 + 0.5).astype(np.int64)
            order = np.argsort(-score, kind="stable")
            if len(order):
                yield j, places[order], score[order]

    def runs(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of equal scores begin, and how long they are."""
        begins = np.nonzero(np.diff(score, prepend=score[0] + 1))[0]
        return begins, np.diff(begins, append=len(score))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(ids), 64 * BINS), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                for j, _, score in scored(_rows_of(batch.slice(i, 1))):
                    counts[j] += np.bincount(_bins(score), minlength=64 * BINS)
        j, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[j, b])], ["j", "bin", "n"])

    # From the highest scores down: the group of each query's bins, and how many scores come before a group.
    group, before, totals = np.zeros((len(ids), 64 * BINS), np.int32), {}, np.zeros(len(ids), np.int64)
    last = np.full(len(ids), -1)
    for r in sorted(blocks.mapInArrow(counted, "j int, bin int, n bigint").groupBy("j", "bin").agg(F.sum("n").alias("n")).collect(), key=lambda r: (r.j, -r.bin)):
        if last[r.j] < 0 or totals[r.j] + r.n - before[r.j, int(last[r.j])] > GROUP:
            last[r.j] += 1
            before[r.j, int(last[r.j])] = int(totals[r.j])
        group[r.j, r.bin] = last[r.j]
        totals[r.j] += r.n

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row, out = batch.slice(i, 1), []
                start, part = row.column("start")[0].as_py(), row.column("part")[0].as_py()
                for j, _, score in scored(_rows_of(row)):
                    begins, lengths = runs(score)
                    values = score[begins]
                    to = group[j][_bins(values)]
                    for g in np.unique(to):
                        out.append((j, int(g), start, part, int((to == g).sum()), packed(values[to == g]), packed(lengths[to == g])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    schema = pa.schema([("j", pa.int32()), ("g", pa.int32()), ("start", {"string": pa.string(), "bigint": pa.int64()}[kind]), ("part", pa.int32()), ("n", pa.int32()), ("scores", pa.binary()), ("lengths", pa.binary())])

    def placed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("start", "ascending"), ("part", "ascending")])
        n = rows.column("n").to_numpy()
        scores, lengths = (np.concatenate([unpacked(d, k) for d, k in zip(rows.column(c).to_pylist(), n)]) for c in ("scores", "lengths"))
        order = np.lexsort((np.repeat(np.arange(len(n)), n), -scores))
        first = np.empty(len(order), np.int64)
        first[order] = np.cumsum(lengths[order]) - lengths[order] + before[rows.column("j")[0].as_py(), rows.column("g")[0].as_py()]
        firsts = [packed(x) for x in np.split(first, np.cumsum(n)[:-1])]
        return rows.select(["j", "g", "start", "part", "n"]).append_column("firsts", pa.array(firsts, pa.binary()))

    def ranked_rows(own: pa.Table, given: pa.Table) -> pa.Table:
        block = _rows_of(own)
        firsts: dict[int, list[np.ndarray]] = {}
        for r in given.sort_by("g").to_pylist():
            firsts.setdefault(r["j"], []).append(unpacked(r["firsts"], r["n"]))
        keys, out = block.column(key), []
        for j, places, score in scored(block):
            begins, lengths = runs(score)
            rank = np.repeat(np.concatenate(firsts[j]) - begins + 1, lengths) + np.arange(len(score))
            out.append(pa.table([pa.array(np.full(len(score), ids[j])), keys.take(pa.array(places)), pa.array(rank)], ["qid", key, "rank"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64()), keys.slice(0, 0), pa.array([], pa.int64())], ["qid", key, "rank"])

    if not held or not fields:
        return blocks.sparkSession.createDataFrame([], f"qid long, {key} {kind}, rank long")
    name = ["start", "part"]
    ranks = blocks.mapInArrow(sent, f"j int, g int, start {kind}, part int, n int, scores binary, lengths binary").groupBy("j", "g").applyInArrow(placed, f"j int, g int, start {kind}, part int, n int, firsts binary")
    named = blocks.select(*(F.col(c).alias(f"of_{c}") for c in name), "data")
    return named.groupBy(*(f"of_{c}" for c in name)).cogroup(ranks.groupBy(*name)).applyInArrow(ranked_rows, f"qid long, {key} {kind}, rank long")


def overlaps(passages: Words, queries: DataFrame, key: str = "chunk_id", block: int = 1_024) -> DataFrame:
    """(qid, key, score): how many words of a passage's fields are among a query's, where any are. Rows with one key count together.

    A passage's pairs are made inside of its row, so that none is shuffled but those of keys that have several rows.
    """
    rows = passages.rows.withColumn("_key", F.xxhash64(key))
    again = staged(rows.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"), "again")
    alone, several = (rows.join(again, "_key", how).drop("_key") for how in ("left_anti", "left_semi"))
    out = None
    for part in query_blocks(queries, block):
        summed = _overlap_block(several, part, passages, key).groupBy("qid", key).agg(F.sum("score").alias("score"))
        found = _overlap_block(alone, part, passages, key).unionByName(summed)
        out = found if out is None else out.unionByName(found)
    return out


def _overlap_block(rows: DataFrame, queries: DataFrame, words: Words, key: str) -> DataFrame:
    held = queries.select("qid", F.array_distinct(tokens(F.coalesce("query", F.lit("")))).alias("terms")).where(F.size("terms") > 0).orderBy("qid").collect()
    at = {t: i for i, t in enumerate(words.terms)}
    asks = np.zeros((len(at), len(held)), bool)
    for j, q in enumerate(held):
        asks[[at[t] for t in q.terms], j] = True
    ids = np.array([q.qid for q in held], np.int64)
    fields = range(len(words.fields))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1_024):
                part = batch.slice(start, 1_024)
                total = np.zeros((len(part), len(ids)))
                for i in fields:
                    lists = part.column(f"_w{i}")
                    row = np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                    own, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
                    matrix = np.zeros((len(part), len(own)))
                    matrix[row, place] = part.column(f"_t{i}").flatten().to_numpy()
                    total += matrix @ asks[own].astype(np.float64)
                at, j = np.nonzero(total)
                for first in range(0, len(at), 65_536):
                    some, which = at[first : first + 65_536], j[first : first + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[which]), part.column(key).take(pa.array(some)), pa.array(total[some, which].astype(np.int64))], ["qid", key, "score"])

    return rows.select(key, *(f"_{x}{i}" for i in fields for x in "wt")).mapInArrow(scored, _pair_schema(rows, key).replace("double", "long"))


def ranked(scored: DataFrame, most: int | None = None, by: str = "qid", key: str = "chunk_id") -> DataFrame:
    """Scores with their rank from 1 in each query, the first ``most`` of them."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col(key))
    out = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    return out if most is None else out.where(F.col("rank") <= most)


def query_blocks(queries: DataFrame, size: int) -> Iterator[DataFrame]:
    """The queries in blocks of about ``size``, by a hash of their id."""
    n = max(1, math.ceil(queries.count() / size))
    for i in range(n):
        yield queries if n == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)


def nearest(passages: DataFrame, queries: DataFrame, most: int = CANDIDATES, key: str = "chunk_id", block: int = 4_096) -> DataFrame:
    """(qid, key, score, rank): exact cosine neighbours among what each query's caller may see.

    Queries (qid, vector, user_id, groups) go to the tasks in blocks of about ``block``, whose size is what the driver and a task
    hold of them; each task keeps its best ``most`` per query, so only those are shuffled. Queries without a vector find nothing.
    """
    out = None
    for part in query_blocks(queries.where("vector IS NOT NULL"), block):
        found = _nearest_block(passages, part, most, key)
        out = found if out is None else out.unionByName(found)
    return ranked(out.withColumn("score", F.round("score", 6)), most, key=key)


def _nearest_block(passages: DataFrame, queries: DataFrame, most: int, key: str) -> DataFrame:
    held = queries.select("qid", F.col("vector").cast("array<double>").alias("vector"), access.tokens_of().alias("tokens")).orderBy("qid").collect()
    schema = f"qid long, {key} {passages.schema[key].dataType.simpleString()}, score double"
    if not held:
        return passages.sparkSession.createDataFrame([], schema)
    matrix = np.array([q.vector for q in held])
    matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)).T
    ids = np.array([q.qid for q in held])
    numbers = {t: i for i, t in enumerate(sorted({t for q in held for t in q.tokens}))}
    holds = np.zeros((len(numbers), len(held)), np.float32)
    for j, q in enumerate(held):
        holds[[numbers[t] for t in q.tokens], j] = 1

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf.vector.to_numpy())
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        tokens = pdf.rights.explode().map(numbers).dropna()
        grants = np.zeros((len(pdf), len(numbers)), np.float32)
        grants[tokens.index.to_numpy(), tokens.to_numpy(np.int64)] = 1
        scores = np.where(grants @ holds > 0, v @ matrix, -np.inf)
        keys = pdf[key].to_numpy()
        # All that ties with the last place stays, as ties are broken by the key.
        least = np.partition(scores, -most, axis=0)[-most] if len(pdf) > most else np.full(len(held), -np.inf)
        i, j = np.nonzero((np.round(scores, 6) >= np.round(least, 6)[None, :]) & np.isfinite(scores))
        return pd.DataFrame({"qid": ids[j], key: keys[i], "score": scores[i, j]})

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, rows = [], 0
        for pdf in parts:
            for at in range(0, len(pdf), 1_024):
                kept.append(scored(pdf.iloc[at : at + 1_024].reset_index(drop=True)))
                rows += len(kept[-1])
            if rows > 4 * most * len(held):
                kept = [first(pd.concat(kept))]
                rows = len(kept[0])
        if kept:
            yield first(pd.concat(kept))

    def first(found: pd.DataFrame) -> pd.DataFrame:
        order = found.assign(r=found.score.round(6)).sort_values(["qid", "r", key], ascending=[True, False, True])
        return order.groupby("qid").head(most).drop(columns="r")

    rows = passages.select(key, F.col("vector").cast("array<double>").alias("vector"), access.rights_of().alias("rights"))
    return rows.mapInPandas(best, schema)


def search(
    passages: DataFrame, questions: DataFrame, mode: str = "hybrid", filters: Filters | None = None, top_k: int | None = None,
    group_by_document: bool = False, rerank: Callable[[DataFrame], Column] | None = None, head: int = 50, index: KeywordIndex | None = None, vectors: VectorIndex | None = None,
) -> DataFrame:
    """(qid, doc_id, chunk_id, score, rank, mode_used): each question's best passages among what its caller may see.

    ``mode`` is hybrid, bm25 or vector. A question (qid, query, vector, user_id, groups) whose vector is null, as its embedding
    failed, is searched by words alone in hybrid mode and refused in vector mode. ``rerank`` gives the column that scores
    a passage (columns of both sides); where it is null for some of a question's first ``head`` hits the reranker failed and
    the order stays. ``index`` is a keyword index of all passages, for many batches of questions; without one the passages are scored in two passes. With ``vectors``,
    an approximate index of all passages, the vector leg probes it; without, it is exact. A hit that its question's caller may not see,
    whatever leg or index brought it, fails the search. ``mode_used`` says what was done: hybrid, bm25 or knn, with ``+rerank``.
    """
    if mode not in ("hybrid", "bm25", "vector"):
        raise ValueError(f"unknown mode {mode}")
    if not questions.where("query IS NULL OR trim(query) = ''").isEmpty():
        raise ValueError("a query needs text")
    if mode == "vector" and not questions.where("vector IS NULL").isEmpty():
        raise ValueError("a question without a vector can't be searched by vector")
    size = page_size(top_k, "x")
    fetch = max(size, head) if rerank else size
    allowed = passages.where((filters or Filters()).predicate())
    legs = {}
    if mode != "vector":
        from . import keyword

        most = max(CANDIDATES, fetch)
        if index is None:
            legs["bm25"] = best_words(passages, questions, most, among=(filters or Filters()).predicate())
        else:
            legs["bm25"] = keyword.top(index, questions, allowed, most)
    if mode != "bm25":
        most = max(CANDIDATES, fetch)
        if vectors is None:
            legs["knn"] = nearest(allowed, questions, most)
        else:
            from . import ann

            legs["knn"] = ann.nearest(vectors, questions, most, (filters or Filters()).predicate())
    found = fused(*legs.values(), most=fetch) if len(legs) == 2 else next(iter(legs.values())).where(F.col("rank") <= fetch).select("qid", "chunk_id", "score", "rank")
    plain = F.when(F.col("vector").isNull(), "bm25").otherwise("hybrid") if mode == "hybrid" else F.lit({"bm25": "bm25", "vector": "knn"}[mode])
    asked = questions.select("qid", "query", plain.alias("mode_used"), access.tokens_of().alias("_held"))
    hits = access.only_admitted(found.join(asked, "qid").join(allowed.select("chunk_id", "doc_id", "content", access.rights_of().alias("_rights")), "chunk_id"))
    if rerank:
        whole = Window.partitionBy("qid")
        hits = hits.withColumn("rerank_score", rerank(hits))
        hits = hits.withColumn("failed", F.max((F.col("rank") <= head) & F.col("rerank_score").isNull()).over(whole))
        hits = hits.withColumn("rerank_score", F.when(F.col("failed"), 0.0).otherwise(F.col("rerank_score"))).withColumn("mode_used", F.when(F.col("failed"), F.col("mode_used")).otherwise(F.concat("mode_used", F.lit("+rerank"))))
        hits = reranked(hits, head)
    if group_by_document:
        hits = best_per_document(hits)
    return hits.where(F.col("rank") <= size).select("qid", "doc_id", "chunk_id", "score", "rank", "mode_used")


def fused(*legs: DataFrame, k: int = RRF_K, most: int | None = 10, key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of ranked legs: the sum of 1 / (k + rank), rounded to nine decimals."""
    both = legs[0].select("qid", key, "rank")
    for leg in legs[1:]:
        both = both.unionByName(leg.select("qid", key, "rank"))
    return ranked(both.groupBy("qid", key).agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score")), most, key=key)


def best_per_document(hits: DataFrame) -> DataFrame:
    """Each document's first hit, in the order of the hits."""
    first = hits.withColumn("at", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("rank"))).where("at = 1").drop("at")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("long"))


def overlap_score(query: Column, content: Column) -> Column:
    """Share of the query's distinct words in a passage: the stand-in for a reranking model."""
    words = F.array_distinct(tokens(query))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect(words, tokens(content))) / F.size(words))


def reranked(hits: DataFrame, head: int = 50) -> DataFrame:
    """The first ``head`` hits by their ``rerank_score``, the others behind them as they were."""
    order = Window.partitionBy("qid").orderBy((F.col("rank") > head).cast("int"), F.when(F.col("rank") <= head, -F.col("rerank_score")).otherwise(0), "rank")
    return hits.withColumn("rank", F.row_number().over(order).cast("long"))
