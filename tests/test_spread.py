"""Texts are shuffled to spread the work only where a table comes in too few parts."""

from pyspark.sql import functions as F

from scrivenry.plans import fixtures as fx
from scrivenry.sources.staging import spread, staged


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, path, files):
    """Documents in ``files`` parts, which are tasks of their own."""
    rows = spark.range(0, 4_400, 1, files).selectExpr("id AS doc_id", "concat('One ', id, '. Two. Three.\n\nFour ', id % 7) AS text", "'en' AS lang", "'s' AS source", "20L AS n_chars")
    rows.write.parquet(f"file://{path}/documents.parquet")
    spark.range(7).withColumnRenamed("id", "vec_id").write.parquet(f"file://{path}/embeddings.parquet")
    return f"file://{path}"


def test_texts_of_a_table_in_many_parts_are_not_shuffled(spark, tmp_path):
    many, one = documents(spark, tmp_path / "many", 8), documents(spark, tmp_path / "one", 1)
    assert "Exchange" not in plan(fx.chunk(spark, many)) and "Exchange" not in plan(fx.chunk_index(spark, many))
    assert "Exchange" in plan(fx.chunk(spark, one))
    found, want = (sorted(map(tuple, fx.chunk(spark, sf).select("chunk_id", "page_no", "content", "section_title").collect())) for sf in (many, one))
    assert found == want and len(found) >= 4_400


def test_a_table_in_few_parts_is_dealt(spark):
    cores = spark.sparkContext.defaultParallelism
    even = spark.range(0, 8_000, 1, 2 * cores)
    assert "Exchange" not in plan(spread(even, "id"))
    assert "Exchange" in plan(spread(even.coalesce(1), "id")) and spread(even.coalesce(1), "id").count() == 8_000
    # All rows but a few lie in one of eight parts.
    uneven = spark.range(0, 8_000, 1, 1).unionByName(spark.range(8_000, 8_007, 1, 7))
    assert "Exchange" in plan(spread(uneven, "id"))
    # Of few rows a long one may be most of the work.
    assert "Exchange" in plan(spread(spark.range(0, 40, 1, 2 * cores), "id"))
    assert spread(spark.range(0), "id").isEmpty()


def test_staged_rows_are_packed_well(spark):
    rows = staged(spark.range(10).select("id", F.lit("a text").alias("text")), "packed")
    assert rows.count() == 10 and all(f.endswith(".zstd.parquet") for f in rows.inputFiles())
