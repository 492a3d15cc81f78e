"""Loaders of question sets and query files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "id string, question string, relevant array<struct<doc_id:string,pages:array<int>>>, reference_answer string, answerable boolean, as_user string, groups array<string>, slice string, tags array<string>, _bad string"


def load_questions(spark: SparkSession, path: str, part: str = "dev", allow_test: bool = False) -> DataFrame:
    """Questions of one slice from JSON lines; the test slice has to be asked for. A bad line or a repeated id is an error."""
    if part == "test" and not allow_test:
        raise ValueError("the test slice needs allow_test")
    rows = spark.read.schema(QUESTION).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NOT NULL OR id IS NOT NULL")
    if not rows.where("_bad IS NOT NULL OR question IS NULL").isEmpty():
        raise ValueError("the question set has lines that are no questions")
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("question ids repeat")
    return rows.drop("_bad").withColumn("answerable", F.coalesce("answerable", F.lit(True))).where(F.coalesce("slice", F.lit("dev")) == part)


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """(question, as_user, groups) from JSON lines or plain text, blank lines skipped."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    got = F.from_json("value", "question string, as_user string, groups array<string>")
    plain = ~F.startswith(F.trim("value"), F.lit("{"))
    return lines.select(F.when(plain, F.trim("value")).otherwise(got["question"]).alias("question"), F.when(~plain, got["as_user"]).alias("as_user"), F.when(~plain, got["groups"]).alias("groups"))


def save_report(report: DataFrame, path: str) -> None:
    """A report as one JSON file."""
    report.coalesce(1).write.mode("error").json(path)
