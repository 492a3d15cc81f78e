"""From ranked passages to prompts: score gate, context within a budget, labels, the filled template; prompt files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import context


def load_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, version, system, user, placeholders, problem) of the files ``<name>.<version>.txt`` in a folder.

    A file has a ``### SYSTEM`` and then a ``### USER`` section, neither blank, and nothing before them; what is otherwise is
    said in ``problem``, and the sections are null then.
    """
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")
    named = F.regexp_extract("file", r"^([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.txt$", 0) != ""
    parts = F.split("value", "### SYSTEM", 2)
    sections = F.split(F.get(parts, F.lit(1)), "### USER", 2)
    bare = lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")
    system, user = bare(F.get(sections, F.lit(0))), bare(F.get(sections, F.lit(1)))
    sound = (F.length(bare(parts[0])) == 0) & (F.length(system) > 0) & (F.length(user) > 0)
    problem = F.when(~named, "invalid name").when(~F.coalesce(sound, F.lit(False)), "malformed")
    names = F.array_distinct(F.regexp_extract_all("user", F.lit(r"\{\{(\w+)\}\}"), F.lit(1)))
    rows = files.select(*(F.when(named, F.regexp_extract("file", r"^([^.]+)\.([^.]+)\.txt$", i)).alias(c) for i, c in ((1, "name"), (2, "version"))), system.alias("system"), user.alias("user"), problem.alias("problem"))
    good = F.col("problem").isNull()
    return rows.select("name", "version", F.when(good, F.col("system")).alias("system"), F.when(good, F.col("user")).alias("user"), F.when(good, names).alias("placeholders"), "problem")


def passes_gate(mode_used: Column, score: Column, least: float) -> Column:
    """Whether a question's best hit is worth an answer: only a reranker's scores can say that it isn't."""
    return ~(F.endswith(mode_used, F.lit("+rerank")) & (score < least))


def prepared(hits: DataFrame, questions: DataFrame, template: str, least: float = 0.0, budget: int = 3_000, most: int = 8, per_doc: int = 3) -> DataFrame:
    """(qid, prompt, refs, reason) for each question: the first half of an answer, up to the model.

    ``hits`` has qid, rank, doc_id, chunk_id, content, label, score and mode_used. A question without hits, or whose best one
    fails the score gate, has no prompt and the reason ``no_context`` or ``low_score``. ``refs`` are the passages (ref,
    chunk_id, tokens) as numbered in the prompt, where ``{{context}}`` and ``{{question}}`` stand for what is filled in.
    """
    if set(re.findall(r"\{\{(\w+)\}\}", template)) != {"context", "question"}:
        raise ValueError("a template has the places context and question")
    best = hits.where("rank = 1").select("qid", (~passes_gate(F.col("mode_used"), F.col("score"), least)).alias("low"))
    chosen = context.select_context(hits.join(best.where("NOT low").select("qid"), "qid", "left_semi"), most, per_doc)
    chosen = chosen.join(hits.select("qid", "chunk_id", "label"), ["qid", "chunk_id"])
    kept = context.budgeted(chosen, budget).join(chosen.select("qid", "ref", "label", "content"), ["qid", "ref"])
    cut = F.call_function("regexp_extract", F.col("content"), F.concat(F.lit("(?Us)^(?:\\s*\\S+){0,"), F.col("tokens"), F.lit("}")), F.lit(0))
    shown = F.concat(F.lit("["), F.col("ref"), F.lit("] "), F.col("label"), F.lit("\n"), cut)
    listed = kept.withColumn("shown", shown).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ref", "chunk_id", "tokens", "shown"))).alias("ps"))
    out = questions.select("qid", "query").join(best, "qid", "left").join(listed, "qid", "left")
    prompt = text.fill_template(template, {"context": F.array_join(F.col("ps.shown"), "\n\n"), "question": F.col("query")})
    refs = F.transform("ps", lambda p: F.struct(p["ref"].alias("ref"), p["chunk_id"].alias("chunk_id"), p["tokens"].alias("tokens")))
    reason = F.when(F.col("low").isNull(), "no_context").when(F.col("low"), "low_score").when(F.col("ps").isNull(), "no_context")
    return out.select("qid", F.when(reason.isNull(), prompt).alias("prompt"), F.when(reason.isNull(), refs).alias("refs"), reason.alias("reason"))
