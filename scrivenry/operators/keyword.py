"""Keyword search over an inverted table: BM25 on several fields, the better of them counts, pruned by the impact of blocks.

The table holds each term's postings in blocks of similar impact, with a block's greatest impact beside it, and each passage's terms
with their impacts. A question first reads its terms' best blocks; the exact scores of the best passages in them give what a passage has to
reach. Blocks whose greatest impact can't bring a passage there, with all that the other terms might add, aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import staged
from . import access
from .retrieval import BM25_FIELDS, B, K1, ranked, tokens

#: Postings that a task gathers by term, steps of impact in a term's range, and how many times the wanted hits are scored to find what to reach.
BLOCK, LEVELS, LEAD = 1 << 22, 32, 2
#: Scores are compared after rounding to six decimals.
SLACK = 1e-5


@dataclass(frozen=True)
class KeywordIndex:
    """(field, term, level, share, n, base, offsets, tfs, lengths) in blocks, (field, term, unit, mean) of terms, and (key, number) with a passage's words: of each field ``_n`` counts them, ``_w`` has the distinct ones, ``_t`` how often."""

    blocks: DataFrame
    terms: DataFrame
    numbers: DataFrame
    key: str
    fields: tuple[str, ...]


def build(passages: DataFrame, fields: Mapping[str, float] = BM25_FIELDS, key: str = "chunk_id", keep: Sequence[str] = ()) -> KeywordIndex:
    """Index the passages' fields (name -> weight). A passage without words in a field doesn't count for that field's statistics.

    Texts are read once; what is written of them are their distinct words. Postings are gathered by term and level of impact inside of a task, so
    none is shuffled and no term's postings meet in one task. An impact is a term's ``unit`` times a share that comes from how often the passage has it and from
    its length, which blocks hold; the share alone makes the level. Inside the index passages go by a number; columns to ``keep`` lie beside it.
    """
    number = F.monotonically_increasing_id().alias("number")
    schema = T.StructType([passages.schema[key], *(passages.schema[c] for c in keep), T.StructField("number", T.LongType())])
    for i in range(len(fields)):
        schema.add(f"_n{i}", T.IntegerType()).add(f"_w{i}", T.ArrayType(T.StringType())).add(f"_t{i}", T.ArrayType(T.IntegerType()))
    words = [tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"_w{i}") for i, f in enumerate(fields)]
    numbered = staged(passages.select(key, *keep, number, *words).mapInArrow(_counted([key, *keep, "number"], len(fields)), schema), "numbered")
    each = lambda *columns: F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(float(w)).alias("weight"), *(F.col(f"_{c}{i}").alias(c) for c in columns)) for i, (f, w) in enumerate(fields.items()))))
    whole = numbered.select(each("n").alias("x")).select("x.*").where("n > 0").groupBy("field", "weight").agg(F.count("*").alias("all"), F.avg("n").alias("mean"))
    df = numbered.select(each("w").alias("x")).select("x.field", F.explode("x.w").alias("term")).groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # One row for each field.
    terms = staged(df.join(F.broadcast(whole), "field").select("field", "term", (F.col("weight") * idf * (K1 + 1)).alias("unit"), "mean"), "terms")
    means = {r.field: r["mean"] for r in whole.collect()}
    own = [(f, i, means[f]) for i, f in enumerate(fields) if f in means]
    blocks = numbered.select("number", *(f"_{x}{i}" for i in range(len(fields)) for x in "nwt")).mapInArrow(_gathered(own), "field string, term string, level int, share double, n bigint, base bigint, offsets array<bigint>, tfs array<int>, lengths array<int>")
    return KeywordIndex(staged(blocks, "blocks"), terms, numbered, key, tuple(fields))


def _counted(keep: Sequence[str], n_fields: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words to distinct words and how often they come, row by row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, names = [batch.column(c) for c in keep], [*keep]
            for i in range(n_fields):
                lists = batch.column(f"_w{i}")
                n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                coded = lists.flatten().dictionary_encode()
                size = max(1, len(coded.dictionary))
                pair, tf = np.unique(np.repeat(np.arange(len(batch)), n) * size + coded.indices.to_numpy(), return_counts=True)
                starts = pa.array(np.searchsorted(pair, np.arange(len(batch) + 1) * size), pa.int32())
                out += [pa.array(n, pa.int32()), pa.ListArray.from_arrays(starts, coded.dictionary.take(pa.array(pair % size))), pa.ListArray.from_arrays(starts, pa.array(tf, pa.int32()))]
                names += [f"_{x}{i}" for x in "nwt"]
            yield pa.RecordBatch.from_arrays(out, names)

    return counted


def _gathered(fields: Sequence[tuple[str, int, float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of some ``BLOCK`` postings at a time: a term's of one level, with the greatest share among them. ``fields`` have a place and a mean length."""

    def emit(kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, i, mean in fields:
            lists = [b.column(f"_w{i}") for b in kept]
            coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            each = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists])
            number, length = (np.repeat(np.concatenate([b.column(c).to_numpy() for b in kept]), each) for c in ("number", f"_n{i}"))
            tf = np.concatenate([b.column(f"_t{i}").flatten().to_numpy() for b in kept])
            share = tf / (tf + K1 * (1 - B + B * length / mean))
            key = coded.indices.to_numpy().astype(np.int64) * LEVELS + np.minimum(np.floor(share * LEVELS).astype(np.int64), LEVELS - 1)
            order = np.argsort(key, kind="stable")
            begins = np.nonzero(np.diff(key[order], prepend=-1))[0]
            ends, of = np.append(begins, len(order)), key[order][begins]
            number, length, tf, share = (x[order] for x in (number, length, tf, share))
            base = number[begins]
            for at in range(0, len(begins), 16_384):
                cut = ends[at : at + 16_385]
                own, some = slice(cut[0], cut[-1]), slice(at, at + len(cut) - 1)
                listed = [pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(x, k)) for x, k in ((number[own] - np.repeat(base[some], np.diff(cut)), pa.int64()), (tf[own], pa.int32()), (length[own], pa.int32()))]
                terms = coded.dictionary.take(pa.array(of[some] // LEVELS))
                made = [pa.array(of[some] % LEVELS, pa.int32()), pa.array(np.maximum.reduceat(share[own], cut[:-1] - cut[0])), pa.array(np.diff(cut)), pa.array(base[some])]
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(terms)), terms, *made, *listed], ["field", "term", "level", "share", "n", "base", "offsets", "tfs", "lengths"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            kept.append(batch)
            held += sum(len(batch.column(f"_w{i}").flatten()) for _, i, _ in fields)
            if held >= BLOCK:
                yield from emit(kept)
                kept, held = [], 0
        if kept:
            yield from emit(kept)

    return gathered


def _impact(tf: str, length: str) -> Column:
    return F.col("unit") * F.col(tf) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / F.col("mean")))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(qid, term) of the questions, once each."""
    return queries.select("qid", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def exact(index: KeywordIndex, pairs: DataFrame, terms: DataFrame, few: bool = False) -> DataFrame:
    """(qid, number, score) of the given (qid, number): the best field's sum of impacts, rounded to six decimals. Of ``few`` pairs, some of each question, the passages are found without a shuffle of all."""
    words = index.numbers.select("number", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_n{i}").alias("length"), F.arrays_zip(F.col(f"_w{i}").alias("term"), F.col(f"_t{i}").alias("tf")).alias("x")) for i, f in enumerate(index.fields)))).alias("w"))
    if few:
        words = words.join(F.broadcast(pairs.select("number").distinct()), "number", "left_semi")
    words = words.select("number", "w.field", "w.length", F.explode("w.x").alias("x")).select("number", "field", "length", "x.term", "x.tf")
    asked = F.broadcast(terms.select("term").distinct())
    words = words.join(asked, "term", "left_semi").join(index.terms.join(asked, "term", "left_semi"), ["field", "term"])
    found = pairs.join(words.select("number", "field", "term", _impact("tf", "length").alias("impact")), "number").join(terms, ["qid", "term"])
    by_field = found.groupBy("qid", "number", "field").agg(F.sum("impact").alias("score"))
    return by_field.groupBy("qid", "number").agg(F.round(F.max("score"), 6).alias("score"))


def top(index: KeywordIndex, queries: DataFrame, passages: DataFrame, most: int) -> DataFrame:
    """(qid, key, score, rank): each question's ``most`` best passages among ``passages`` that its caller may see.

    ``queries`` has qid, query, user_id and groups. The result is that of scoring all postings; a question without known terms finds
    nothing.
    """
    return _searched(index, queries, passages, most)[0]


def postings_read(index: KeywordIndex, queries: DataFrame, passages: DataFrame | None, most: int) -> DataFrame:
    """(qid, postings, read): how many postings each question's terms have, and how many the search reads. Without ``passages`` it is among all of an index that keeps their rights."""
    _, known, taken = _searched(index, queries, passages, most)
    return known.groupBy("qid").agg(F.sum("n").alias("postings")).join(taken.groupBy("qid").agg(F.sum("n").alias("read")), "qid")


def _searched(index: KeywordIndex, queries: DataFrame, passages: DataFrame | None, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = "number"
    rights = ["acl_users", "acl_groups"]
    passages = index.numbers.select(key, *rights) if passages is None else passages.select(index.key, *rights).join(index.numbers.select(index.key, key), index.key).drop(index.key)
    terms = staged(asked_terms(queries), "terms")
    # The distinct words of a stated set of questions.
    asked = F.broadcast(terms.select("term").distinct())
    own = index.blocks.select("field", "term", "level", "share", "n").join(asked, "term", "left_semi").groupBy("field", "term", "level").agg(F.max("share").alias("share"), F.sum("n").alias("n"))
    own = own.join(index.terms.join(asked, "term", "left_semi"), ["field", "term"]).withColumn("bound", F.col("unit") * F.col("share"))
    known = staged(terms.join(own.select("field", "term", "level", "bound", "n"), "term"), "known")
    # The levels a question reads first: from the top down until they hold some hits, for each term.
    level = known.groupBy("qid", "field", "term", "level").agg(F.sum("n").alias("n"), F.max("bound").alias("bound"))
    down = Window.partitionBy("qid", "field", "term").orderBy(F.desc("level"))
    level = level.withColumn("before", F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("most", F.max("bound").over(Window.partitionBy("qid", "field", "term")))
    level = staged(level, "levels")
    lead = level.where(F.col("before") < most).select("qid", "field", "term", "level")
    first = _read(index, lead)
    best = F.array_max(F.array(*(F.sum(F.when(F.col("field") == f, F.col("impact"))) for f in index.fields)))
    least = access.admitted(first.groupBy("qid", key).agg(best.alias("score")), passages, queries, key)
    met = staged(exact(index, staged(ranked(least, LEAD * most, key=key).select("qid", key), "lead"), terms, few=True), "met")
    reach = ranked(met, most, key=key).where(F.col("rank") == most).select("qid", (F.col("score") - SLACK).alias("reach"))
    # A level is worth reading if its best impact, and the most of all other terms of the field, come to what is to be reached; of
    # the terms with the smallest impacts, those that together stay below it need no reading at all: what has only those is beaten.
    totals = level.where("before = 0").groupBy("qid", "field").agg(F.sum("most").alias("total"))
    small = Window.partitionBy("qid", "field").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = level.where("before = 0").select("qid", "field", "term", F.sum("most").over(small).alias("together"))
    open_levels = level.join(totals, ["qid", "field"]).join(sums, ["qid", "field", "term"]).join(reach, "qid", "left")
    open_levels = open_levels.where(F.col("reach").isNull() | ((F.col("bound") + F.col("total") - F.col("most") >= F.col("reach")) & (F.col("together") >= F.col("reach"))))
    chosen = staged(open_levels.select("qid", "field", "term", "level").unionByName(lead).distinct(), "chosen")
    # What the rest may add to a passage's sum: of unread levels at most the best unread one, for each term.
    unread = level.join(chosen, ["qid", "field", "term", "level"], "left_anti").groupBy("qid", "field", "term").agg(F.max("bound").alias("bound")).groupBy("qid", "field").agg(F.sum("bound").alias("rest"))
    seen = _read(index, chosen).groupBy("qid", key, "field").agg(F.sum("impact").alias("score")).join(unread, ["qid", "field"], "left").join(reach, "qid", "left")
    worth = seen.where(F.col("reach").isNull() | (F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.col("reach"))).select("qid", key).distinct()
    others = access.admitted(worth.join(met, ["qid", key], "left_anti"), passages, queries, key)
    scores = met.unionByName(exact(index, others, terms))
    return ranked(scores.join(index.numbers.select(index.key, "number"), "number").select("qid", index.key, "score"), most, key=index.key), known, chosen.join(known, ["qid", "field", "term", "level"])


def _read(index: KeywordIndex, levels: DataFrame) -> DataFrame:
    """(qid, number, field, impact) of the postings in the given levels of terms."""
    wanted = F.broadcast(levels.select("field", "term", "level").distinct())
    units = index.terms.join(F.broadcast(levels.select("field", "term").distinct()), ["field", "term"], "left_semi")
    own = index.blocks.join(wanted, ["field", "term", "level"], "left_semi").join(F.broadcast(units), ["field", "term"])
    rows = levels.join(own, ["field", "term", "level"]).select("qid", "field", "unit", "mean", "base", F.explode(F.arrays_zip("offsets", "tfs", "lengths")).alias("x"))
    return rows.select("qid", (F.col("base") + F.col("x.offsets")).alias("number"), "field", "unit", "mean", F.col("x.tfs").alias("tf"), F.col("x.lengths").alias("length")).select("qid", "number", "field", _impact("tf", "length").alias("impact"))
