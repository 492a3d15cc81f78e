"""Answers measured: what they cite, whether it is what was asked for, and the outcome of each question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing, text


def cited_sources(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(name, qid, ref, known, doc_id, pages): each reference of an answer once, with the passage that it numbers.

    ``answers`` has name (of the prompt or run), qid and answer; ``contexts`` has the numbered passages qid, ref, doc_id and
    pages. A reference to no passage of the question's context isn't known and has no document. Null answers cite nothing.
    """
    refs = answers.select("name", "qid", F.explode(text.citation_refs(F.col("answer"))).alias("ref")).withColumn("ref", F.col("ref").cast("long"))
    numbered = contexts.select("qid", F.col("ref").cast("long").alias("ref"), F.lit(True).alias("known"), "doc_id", "pages")
    return refs.join(numbered, ["qid", "ref"], "left").select("name", "qid", "ref", F.coalesce("known", F.lit(False)).alias("known"), "doc_id", "pages")


def correct_citations(cited: DataFrame, relevant: DataFrame) -> DataFrame:
    """(name, qid, ref, doc_id, correct) of known references: a relevant (qid, doc_id, pages) names the document and, if both sides have pages, one of them."""
    wanted = relevant.select("qid", "doc_id", F.col("pages").alias("wanted"))
    met = cited.where("known").join(wanted, ["qid", "doc_id"], "left")
    hit = F.col("wanted").isNotNull() & ((F.size("wanted") == 0) | (F.size("pages") == 0) | F.arrays_overlap("pages", "wanted"))
    return met.groupBy("name", "qid", "ref", "doc_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("correct"))


def answer_outcomes(answers: DataFrame, contexts: DataFrame, relevant: DataFrame) -> DataFrame:
    """(name, qid, answerable, refused, cited, correct, faithfulness, relevance) of each answer.

    ``answers`` has name, qid, answer and ``said``, the judge's words on it (null: not judged). A question is answerable when
    something is relevant to it. An answer that says that nothing was found, or that cites no known passage, is a refusal.
    """
    judged = correct_citations(cited_sources(answers, contexts), relevant).groupBy("name", "qid").agg(F.count("*").alias("cited"), F.count(F.when(F.col("correct"), 1)).alias("correct"))
    known = relevant.select("qid").distinct().withColumn("answerable", F.lit(True))
    out = answers.join(judged, ["name", "qid"], "left").join(known, "qid", "left")
    n = F.coalesce("cited", F.lit(0))
    refused = F.coalesce(text.is_not_found(F.col("answer")), F.lit(True)) | (n == 0)
    return out.select(
        "name", "qid", F.coalesce("answerable", F.lit(False)).alias("answerable"), refused.alias("refused"), n.alias("cited"), F.coalesce("correct", F.lit(0)).alias("correct"),
        parsing.faithfulness(F.col("said")).alias("faithfulness"), parsing.relevance(F.col("said")).alias("relevance"),
    )
