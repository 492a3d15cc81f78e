"""What holds a question's text is few: it goes to the texts and pages, which aren't shuffled."""

import contextlib

from scrivenry.operators import context
from scrivenry.plans import evaluation_queries as eq


@contextlib.contextmanager
def broadcast_below(spark, size):
    """Tables of over ``size`` bytes are taken for large."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_shuffled_for_what_they_may_hold(spark, tmp_path):
    words = "concat_ws(' ', transform(sequence(0, 40), i -> sha2(string(id * 50 + i), 256)))"
    spark.range(2_000).selectExpr("id AS doc_id", f"if(id % 500 = 7, concat({words}, ' one two three four five ', id), {words}) AS text").write.parquet(f"file://{tmp_path}/texts")
    rows = spark.read.parquet(f"file://{tmp_path}/texts")
    items = spark.createDataFrame([(1, "two three four"), (2, "e two three four five 5"), (3, "no such words here"), (4, "one two three four five 1007")], "qid long, item string")
    with broadcast_below(spark, 100_000):
        found = context.holding(rows, items)
        assert "SortMergeJoin" not in plan(found) and "hashpartitioning(doc_id" not in plan(found)
        assert sorted(map(tuple, found.select("qid", "doc_id").collect())) == [(1, 7), (1, 507), (1, 1007), (1, 1507), (2, 507), (4, 1007)]


def test_pages_are_not_shuffled_for_relevant_documents(spark):
    with broadcast_below(spark, 50_000):
        assert "SortMergeJoin" not in plan(eq.relevant_pages(spark, "/root/testdata/sf0.001"))
