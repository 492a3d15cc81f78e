"""Retrieval experiments: many configurations from legs that are computed once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics


@dataclass(frozen=True)
class Config:
    """One way to search: which legs, the constant of their fusion, one hit for each document or all, and hits that are reranked."""

    name: str
    legs: tuple[str, ...] = ("bm25", "knn")
    k: int = 60
    by_document: bool = False
    rerank: int = 0


def ranked_by(legs: dict[str, DataFrame], configs: list[Config], documents: DataFrame, scores: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(name, idx, qid, doc_id, rank): the ``most`` best hits of each question under each configuration.

    ``legs`` have qid, chunk_id and rank; ``documents`` chunk_id and doc_id; ``scores``, the reranker's, qid, chunk_id and one more. The legs meet once in a
    table of (qid, chunk_id) with a rank for each; a configuration is an expression over its row.
    """
    both = None
    for name, leg in legs.items():
        own = leg.select("qid", "chunk_id", F.col("rank").alias(f"rank_{name}"))
        both = own if both is None else both.join(own, ["qid", "chunk_id"], "full")
    rows = both.join(documents, "chunk_id")
    if scores is None:
        rows = rows.withColumn("rerank", F.lit(None).cast("double"))
    else:
        rows = rows.join(scores.toDF("qid", "chunk_id", "rerank"), ["qid", "chunk_id"], "left")

    def entry(idx: int, c: Config) -> Column:
        score = sum((F.coalesce(1 / (c.k + F.col(f"rank_{leg}")), F.lit(0.0)) for leg in c.legs), F.lit(0.0))
        found = F.coalesce(*(F.col(f"rank_{leg}") for leg in c.legs)).isNotNull()
        return F.when(found, F.struct(F.lit(c.name).alias("name"), F.lit(idx).alias("idx"), F.round(score, 9).alias("score"), F.lit(c.by_document).alias("by_document"), F.lit(c.rerank).alias("head")))

    spread = rows.select("qid", "chunk_id", "doc_id", "rerank", F.explode(F.filter(F.array(*(entry(i, c) for i, c in enumerate(configs))), lambda x: x.isNotNull())).alias("c")).select("qid", "chunk_id", "doc_id", "rerank", "c.*")
    one = Window.partitionBy("name", "qid")
    placed = spread.withColumn("rank", F.row_number().over(one.orderBy(F.desc("score"), "chunk_id")))
    again = one.orderBy((F.col("rank") > F.col("head")).cast("int"), F.when(F.col("rank") <= F.col("head"), -F.col("rerank")).otherwise(0), "rank")
    placed = placed.withColumn("rank", F.row_number().over(again)).withColumn("nth", F.row_number().over(Window.partitionBy("name", "qid", "doc_id").orderBy("rank")))
    kept = placed.where(~F.col("by_document") | (F.col("nth") == 1)).withColumn("rank", F.row_number().over(one.orderBy("rank")).cast("long"))
    return kept.where(F.col("rank") <= most).select("name", "idx", "qid", "doc_id", "rank")


def matrix(hits: DataFrame, relevant: DataFrame, questions: DataFrame, baseline: str) -> DataFrame:
    """(name, value, delta, best): mean reciprocal rank of each configuration over all questions that have a relevant document."""
    asked = questions.select("qid").join(relevant.select("qid").distinct(), "qid", "left_semi")
    first = hits.join(relevant, ["qid", "doc_id"]).groupBy("name", "idx", "qid").agg(F.min("rank").alias("first"))
    names = hits.select("name", "idx").distinct()
    every = names.crossJoin(F.broadcast(asked.agg(F.count("*").alias("n"))))
    value = every.join(first.groupBy("name").agg(F.sum(1 / F.col("first")).alias("total")), "name", "left")
    return metrics.comparison(value.select("name", "idx", F.round(F.coalesce("total", F.lit(0.0)) / F.col("n"), 4).alias("value")), baseline, "value")
