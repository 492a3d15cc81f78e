"""Intermediate results as Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder that executors share: under spark.checkpoint.dir, or a temporary one for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written once and read again, for what several branches of a plan use."""
    path = scratch(rows.sparkSession, label)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame, key: str, least: int = 1_000) -> DataFrame:
    """``rows`` as they are read if no task's part is more than twice an even share of the cores, else dealt by ``key``.

    A large table comes in parts enough, so its texts needn't be shuffled. With fewer than ``least`` rows for each core a long text
    among them may be most of a part, and dealing costs little. Counting reads no column.
    """
    parts = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if least * cores <= sum(parts) and max(parts) * cores <= 2 * sum(parts) else rows.repartition(key)
